"""Row-by-row reference procedures in pandas, for small tables only."""

import math

import numpy as np
import pandas as pd


def normal(x, m, s):
    if s == 0 or math.isnan(s):
        return math.nan
    return -((x - m) ** 2) / (2 * s * s) - 0.5 * math.log(2 * math.pi * s * s)


def mask(df, parents, row):
    m = np.ones(len(df), bool)
    for p in parents:
        if p.role.value == "band":
            m &= (df[p.attr] - row[p.attr]).abs().round(6).to_numpy() <= p.radius
        else:
            m &= (df[p.attr] == row[p.attr]).to_numpy()
    return m


def relaxed_mask(df, parents, row):
    m = np.ones(len(df), bool)
    for p in parents:
        trial = m & mask(df, [p], row)
        if trial.sum():
            m = trial
    return m


def cat_lp(df, m, attr, value):
    got = df.loc[m, attr]
    counts = got.value_counts()
    unseen = df[attr].nunique() - len(counts)
    n = len(got)
    if n == 0:
        return -math.log(df[attr].nunique())
    if value in counts.index:
        p = counts[value] / (n * (1.1 if unseen > 0 else 1.0))
    else:
        p = 0.1 / (1.1 * unseen)
    return math.log(p)


def num_lp(df, m, attr, value, greater_zero=False):
    src = df[attr] if m.sum() <= 1 else df.loc[m, attr]
    if greater_zero and value < 0:
        return -66.0
    s = 0.0 if src.min() == src.max() else src.std()
    return normal(value, src.mean(), s)


def cosine(u, v):
    return 1 - float((u * v).sum()) / (math.sqrt((u * u).sum()) * math.sqrt((v * v).sum()))


def emb_mask(df, emb, parents, row, k, id_col):
    hit = np.ones(len(df), bool)
    bandm = np.ones(len(df), bool)
    hard = np.ones(len(df), bool)
    soft = []
    for p in parents:
        r = p.role.value
        if r == "soft":
            hit &= (df[p.attr] == row[p.attr]).to_numpy()
            soft.append(p.attr)
        elif r == "band":
            bandm &= (df[p.attr] - row[p.attr]).abs().round(6).to_numpy() <= p.radius
        else:
            hard &= (df[p.attr] == row[p.attr]).to_numpy()
    m = hit & bandm
    n = m.sum()
    if n < k:
        free = np.flatnonzero(~m & bandm & hard)
        found = []
        for i in free:
            d = 0.0
            for a in soft:
                d += round(abs(cosine(emb[a, str(row[a])], emb[a, str(df[a].iloc[i])])), 12)
            found.append((d, df[id_col].iloc[i], i))
        for _, _, i in sorted(found)[: k - n]:
            m[i] = True
    return m


def score(obs, spec, id_col, emb=None, rows=None):
    rows = obs if rows is None else rows
    out = []
    for _, row in rows.iterrows():
        rec = {id_col: row[id_col]}
        for n in spec.nodes:
            x = row[n.attr]
            kind = n.kind.value
            if kind == "uniform":
                v = -math.log(obs[n.attr].nunique()) if (obs[n.attr] == x).any() else -math.inf
            elif kind == "freq":
                c = (obs[n.attr] == x).sum()
                v = math.log(c / len(obs)) if c else -math.inf
            elif kind == "uniform_cont":
                lo, hi = obs[n.attr].min(), obs[n.attr].max()
                v = -math.log(hi - lo) if lo <= x <= hi else -math.inf
            elif kind == "bernoulli":
                p = obs[n.attr].astype(float).mean()
                v = math.log(p if x else 1 - p)
            else:
                if kind.startswith("emb"):
                    m = emb_mask(obs, emb, n.parents, row, n.k, id_col)
                else:
                    m = mask(obs, n.parents, row) if n.strict else relaxed_mask(obs, n.parents, row)
                if n.numeric:
                    v = num_lp(obs, m, n.attr, x, n.greater_zero)
                else:
                    v = cat_lp(obs, m, n.attr, x)
            rec[f"lp_{n.attr}"] = v
        rec["score"] = sum(rec[f"lp_{n.attr}"] for n in spec.nodes)
        out.append(rec)
    return pd.DataFrame(out)
