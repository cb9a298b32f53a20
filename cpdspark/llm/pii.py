"""Find personal data by labelers that vote, with DataFrame functions only.

Candidates are matches of eight patterns. Four kinds are fixed by their pattern and a test (``email``, ``ip``,
``card``, ``phone``): their spans are always reported. The others are looser (numbers with separators,
accounts, addresses in words, persons), and most of their matches are nothing personal. Five labelers, none of
them certain, vote for or against a candidate, or abstain:

* form: a regular expression of the usual groupings, or of dates and decimals (against);
* context: words before it (call, Konto, née / version, Seite), in four languages;
* checksum: Luhn or modulo 97;
* gazetteer: calling codes, top-level domains, forms of address and given names / reserved addresses, dummy numbers;
* surroundings: against what is part of a longer word.

Expectation-maximisation finds how reliable each labeler is, and how many candidates of a kind are personal,
from the counts of vote patterns of all candidates of the table (at most 8 * 3^5). Its posteriors are the labels
of the final classifier, a logistic regression on the features of the span, fitted to their sums per feature
pattern (at most 8 * 2^11). A loose candidate is reported if the classifier is sure, more labelers vote for it
than against it, and no fixed span overlaps it.

Positions are code points, end exclusive. Matches are marked inside the text by two control characters that
no pattern can match; where a text has them itself, a third one stands in. Of a text's pieces only lengths,
flags and a few characters around each match are shuffled.

Defined cases: a null text is empty; each row is its own unit, so null or repeated doc_ids and repeated rows
need no rule; an empty table gives no rows, and a table without candidates rows without spans; other columns
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpdspark.functions.lineage import cut

_ON, _OFF, _OTHER = "\u0001", "\u0002", "\u0003"
_LOCAL = "[A-Za-z0-9._%+-]"

# Fixed word lists.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra"
GIVEN_NAMES = (
    "Anna Antonio Carlos Charles Christine Claude Daniel David Elena Elizabeth Emma François Fritz Hans Heinrich Isabel "
    "James Jean Jennifer Johann John José Juan Julia Jürgen Karl Klaus Laura Linda Louis Luis Manuel María Maria Marie "
    "Martin Mary Michael Michel Miguel Monika Nathalie Nicolas Pablo Patricia Paul Peter Petra Philippe Pierre Robert "
    "Sabine Sarah Sofía Sophie Stefan Susan Thomas Ursula Werner William Wolfgang"
)
CONTEXT_FOR = (
    "phone telephone tel mobile cell call fax whatsapp contact email e-mail mail reach card visa mastercard credit account "
    "iban ssn passport patient name named born telefon handy anruf konto karte ausweis geboren erreichbar téléphone portable "
    "appelez courriel compte carte passeport né née teléfono móvil llame correo cuenta tarjeta dni nif nacido nacida"
)
CONTEXT_AGAINST = (
    "version isbn issn page pages figure chapter section order invoice ticket build release patch port line row total sum "
    "price usd eur doi rfc year seite kapitel bestellung rechnung preis jahr commande facture prix chapitre année pedido "
    "factura precio página capítulo año"
)
TOP_LEVEL_DOMAINS = "com org net edu gov info io de fr es uk it nl eu ch at"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 351 353 358 420"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    possible: str  # what a text with a valid match has
    fixed: bool


_either = lambda words: "|".join(words.split())

#: A run of local characters matters from its start only, or from the end of the match before: so texts of one
#: run take linear time. Groups are possessive, which changes no match here and needs no stack.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    Kind("number", r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+", r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}", False),
    Kind(
        "account",
        r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
        r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{4}",
        False,
    ),
    Kind(
        "spelled",
        rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[{{](?i:at)[)\]}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{{](?i:dot)[)\]}}])\x20?[A-Za-z0-9-]++)++",
        r"[(\[{](?i:at)[)\]}]",
        False,
    ),
    Kind(
        "person",
        rf"(?<!\p{{L}})(?:{_either(TITLES)}|{_either(GIVEN_NAMES)})\.?\x20\p{{Lu}}\p{{Ll}}++(?:[\x20-]\p{{Lu}}\p{{Ll}}++)?",
        rf"(?<!\p{{L}})(?:{_either(TITLES)}|{_either(GIVEN_NAMES)})\.?\x20\p{{Lu}}\p{{Ll}}",
        False,
    ),
)
FIXED = tuple(k.name for k in KINDS if k.fixed)
LABELERS = ("form", "context", "checksum", "gazetteer", "surroundings")
FEATURES = ("named", "counted", "glued", "separated", "long", "dated", "grouped", "checked", "failed", "listed", "barred")
_ORDER = {k.name: i for i, k in enumerate(KINDS)}

AROUND = 32  # characters before a match that are looked at
KEPT = 64  # characters of a match that are looked at
THRESHOLD = 0.9


def _pieces(documents: DataFrame) -> DataFrame:
    """``_row, doc_id, order, i, piece``: texts cut before each match, kind by kind; a piece is match, mark, gap."""
    text = F.translate(F.coalesce("text", F.lit("")), _ON + _OFF, _OTHER + _OTHER)
    rows = documents.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("text"))
    none = F.array().cast("array<struct<order:int,i:int,piece:string>>")

    def of_kind(order: int, kind: Kind) -> Column:
        cut_up = F.split(F.regexp_replace("text", kind.pattern, f"{_ON}$0{_OFF}"), _ON)
        each = F.transform(cut_up, lambda p, i: F.struct(F.lit(order).alias("order"), i.alias("i"), p.alias("piece")))
        return F.when(F.col("text").rlike(kind.possible), each).otherwise(none)

    hits = F.concat(*[of_kind(o, k) for o, k in enumerate(KINDS)])
    return rows.select("_row", "doc_id", F.explode_outer(hits).alias("p")).select("_row", "doc_id", "p.*")


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass; false for other lengths."""

    def add(total: Column, k: Column) -> Column:
        x = F.substr(digits, -k, F.lit(1)).cast("int") * (F.lit(2) - k % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    n = F.length(digits)
    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _mod97(account: Column) -> Column:
    """Whether an account number of at most 35 characters has the remainder 1, its head moved to the end."""
    packed = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(packed, 5, KEPT), F.substring(packed, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        x = F.ascii(c)
        return F.when(x >= 65, (rest * 100 + x - 55) % 97).otherwise((rest * 10 + x - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c))) == 1


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(order: Column, match: Column, digits: Column) -> Column:
    """Whether a match passes the test of its kind."""
    n = F.length(digits)
    return (
        F.when(order == _ORDER["ip"], match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(order == _ORDER["card"], _luhn(digits))
        .when(order == _ORDER["phone"], n.between(9, 15))
        .when(order == _ORDER["number"], n.between(7, 15))
        .otherwise(F.lit(True))
    )


def _is(order: Column, *names: str) -> Column:
    return order.isin([_ORDER[n] for n in names])


_GROUPED = r"^(?:\(?0?[0-9]{2,4}\)?[\x20/.-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
_DATED = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}.*|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}.*|(?:19|20)[0-9]{2}\x20?-\x20?(?:19|20)[0-9]{2}|[0-9]+\.[0-9]+)$"
_FULL_NAME = rf"^(?:{_either(TITLES)})\.?\x20(?:(?:{_either(GIVEN_NAMES)})\x20\p{{Lu}}|\p{{L}}+[\x20-]\p{{Lu}})"
_DUMMY = r"^(?:([0-9])\1+|0?12345678?9?0?|0?1234567|9876543(?:210?)?)$"
_RESERVED_IP = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|192\.0\.2|198\.51\.100|203\.0\.113|2[2-5][0-9])\."


def _evidence(rows: DataFrame) -> DataFrame:
    """``_row, doc_id, start, order, end, fixed, votes, bits`` of each valid match, and one row for each row without."""
    order, match, left, right, digits = (F.col(c) for c in ("order", "match", "left", "right", "digits"))
    before = lambda words: left.rlike(rf"(?i)(?<!\p{{L}})(?:{_either(words)})(?!\p{{L}})[^.!?\n]{{0,20}}$|(?i)(?<!\p{{L}})(?:{_either(words)})\.\x20?$")
    named, counted = before(CONTEXT_FOR), before(CONTEXT_AGAINST)
    glued = left.rlike(r"[\p{L}\p{N}_=/#$€£-]$") | right.rlike(r"^(?:[\p{L}\p{N}_=%€]|[.,][0-9])")
    number = _is(order, "number")
    dated = number & match.rlike(_DATED)
    full_name = _is(order, "person") & match.rlike(_FULL_NAME)
    grouped = (_is(order, *FIXED) | _is(order, "spelled") | full_name | (number & match.rlike(_GROUPED))) & ~dated
    sums = F.when(_is(order, "card"), F.lit(1)).when(_is(order, "account"), F.when(_mod97(match), 1).otherwise(-1)).otherwise(0)
    plain = (
        (_is(order, "email", "spelled") & match.rlike(rf"(?i)[.\])}}]\x20?(?:{_either(TOP_LEVEL_DOMAINS)})$"))
        | (_is(order, "phone") & match.rlike(rf"^\+(?:{_either(CALLING_CODES)})"))
        | (_is(order, "card") & digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"))
        | (_is(order, "person") & match.rlike(rf"^(?:(?:{_either(TITLES)})\.?\x20|(?:{_either(GIVEN_NAMES)})\x20\p{{L}}+[\x20-])"))
    )
    barred = (_is(order, "ip") & match.rlike(_RESERVED_IP)) | (_is(order, "number", "phone") & digits.rlike(_DUMMY))
    sign = lambda yes, no: F.when(yes & ~no, 1).when(no & ~yes, -1).otherwise(0)
    votes = [sign(grouped, dated), sign(named, counted), sums, sign(plain, barred), F.when(glued, -1).otherwise(0)]
    bits = [named, counted, glued, match.rlike(r"[\x20()./-]"), F.length(digits) >= 9, dated, grouped, sums == 1, sums == -1, plain, barred]
    code = F.lit(0)
    for i, v in enumerate(votes):
        code = code + (v + 1) * 3**i
    mask = F.lit(0)
    for i, b in enumerate(bits):
        mask = mask + F.coalesce(b, F.lit(False)).cast("int") * (1 << i)
    there = F.col("valid")
    only = lambda c: F.when(there, c)
    return rows.select(
        "_row",
        "doc_id",
        "start",
        only(order).alias("order"),
        (F.col("start") + F.col("size")).alias("end"),
        only(_is(order, *FIXED)).alias("fixed"),
        only(code).cast("int").alias("votes"),
        only(mask).cast("int").alias("bits"),
    )


def candidates(documents: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id`` and ``found``, an array of ``(start, order, end, fixed, free, votes, bits)``.

    ``free`` tells that no fixed span overlaps a candidate.
    """
    piece, is_match = F.col("piece"), F.col("i") > 0
    match = F.when(is_match, F.substring_index("piece", _OFF, 1))
    parts = _pieces(documents).withColumn("match", match)
    parts = parts.withColumn("digits", F.regexp_replace("match", "[^0-9]++", ""))
    short = parts.select(
        "_row",
        "doc_id",
        "order",
        "i",
        (F.length(piece) - is_match.cast("int")).cast("long").alias("total"),
        F.length("match").cast("long").alias("size"),
        F.coalesce(_valid(F.col("order"), F.col("match"), F.col("digits")) & is_match, F.lit(False)).alias("valid"),
        F.substring("digits", 1, 20).alias("digits"),
        F.when(F.length("match") <= KEPT, F.col("match")).otherwise(F.concat(F.substring("match", 1, KEPT // 2), F.right("match", F.lit(KEPT // 2)))).alias("match"),
        F.substring_index(F.right(piece, F.lit(AROUND)), _OFF, -1).alias("tail"),
        F.substr(piece, F.length("match") + 2, F.lit(2)).alias("right"),
    )
    before = Window.partitionBy("_row", "order").orderBy("i")
    placed = short.repartition("_row").select(
        "*",
        F.coalesce(F.sum("total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.coalesce(F.lag("tail").over(before), F.lit("")).alias("left"),
    )
    # the first piece of each row's kind, or the only row of a text without any, keeps the row in the result
    seen = _evidence(placed.filter(F.col("valid") | (F.coalesce("i", F.lit(0)) == 0)))
    place = F.struct("start", "order", "end")
    passed = lambda by: Window.partitionBy("_row").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.when(F.col("fixed"), F.col("end"))).over(passed(place.asc()))
    starts = F.min(F.when(F.col("fixed"), F.col("start"))).over(passed(place.desc()))  # of those behind; a frame that grows costs a step a row
    free = ~(F.coalesce(ends, F.lit(-1)) > F.col("start")) & ~(F.coalesce(starts, F.col("end")) < F.col("end"))
    span = F.struct("start", "order", "end", "fixed", free.alias("free"), "votes", "bits")
    listed = seen.select("_row", "doc_id", F.when(F.col("order").isNotNull(), span).alias("s"))
    return listed.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("found")).drop("_row")


@dataclass(frozen=True)
class Model:
    reliability: dict[str, float]  # of each labeler: how often a vote is right
    share: dict[str, float]  # of each kind: how many candidates are personal
    intercepts: list[float]  # by kind
    weights: list[float]  # by feature


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(len(LABELERS))]


def _posterior(votes: list[int], reliability: list[float], share: float) -> float:
    odds = math.log(share / (1 - share))
    for v, r in zip(votes, reliability):
        odds += v * math.log(r / (1 - r))
    return 1 / (1 + math.exp(-odds))


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 60) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over ``(order, votes, n)``: reliability by labeler, personal share by kind.

    A vote is right with its labeler's reliability, whatever the class; who abstains says nothing. Beta priors
    (8 right of 10 votes; 1 personal of 2 candidates) keep both inside (0, 1), and say which class is which.
    """
    table = [(o, _votes(c), n) for o, c, n in sorted(counts) if any(_votes(c))]
    reliability, share = [0.8] * len(LABELERS), [0.5] * len(KINDS)
    for _ in range(rounds):
        right, voted = [8.0] * len(LABELERS), [10.0] * len(LABELERS)
        personal, of_kind = [1.0] * len(KINDS), [2.0] * len(KINDS)
        for order, votes, n in table:
            p = _posterior(votes, reliability, share[order])
            personal[order] += n * p
            of_kind[order] += n
            for i, v in enumerate(votes):
                if v:
                    right[i] += n * (p if v > 0 else 1 - p)
                    voted[i] += n
        reliability = [min(0.999, a / b) for a, b in zip(right, voted)]
        share = [a / b for a, b in zip(personal, of_kind)]
    return reliability, share


def train(sums: list[tuple[int, int, int, float]], ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with soft labels, from ``(order, bits, n, sum of labels)``."""
    width = len(KINDS) + len(FEATURES)
    if not sums:
        return np.zeros(width)
    x = np.array([[o == k for k in range(len(KINDS))] + [b >> i & 1 for i in range(len(FEATURES))] for o, b, *_ in sorted(sums)], float)
    n, y = (np.array([s[i] for s in sorted(sums)], float) for i in (2, 3))
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


def fit(found: DataFrame) -> Model:
    """The labelers' reliabilities and the span classifier, from all ``candidates`` that have a vote."""
    spans = found.select(F.explode("found").alias("s")).groupBy("s.order", "s.votes", "s.bits").agg(F.count(F.lit(1)).alias("n"))
    spans = cut(spans)
    counts = [(r.order, r.votes, r.n) for r in spans.groupBy("order", "votes").agg(F.sum("n").alias("n")).collect()]
    reliability, share = reliabilities(counts)
    # in millionths, so that the sums are whole numbers and do not depend on their order
    label = {(o, c): round(1e6 * _posterior(_votes(c), reliability, share[o])) for o, c, _ in counts if any(_votes(c))}
    if not label:
        return Model(dict(zip(LABELERS, reliability)), {k.name: s for k, s in zip(KINDS, share)}, [0.0] * len(KINDS), [0.0] * len(FEATURES))
    lookup = F.create_map(*[F.lit(x) for (o, c), p in sorted(label.items()) for x in (o * 1000 + c, p)])
    labelled = spans.withColumn("label", F.element_at(lookup, F.col("order") * 1000 + F.col("votes"))).dropna()
    sums = labelled.groupBy("order", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("y"))
    w = train([(r.order, r.bits, r.n, r.y / 1e6) for r in sums.collect()]).tolist()
    return Model(dict(zip(LABELERS, reliability)), {k.name: s for k, s in zip(KINDS, share)}, w[: len(KINDS)], w[len(KINDS) :])


def _probability(span: Column, model: Model) -> Column:
    z = F.get(F.array(*[F.lit(float(x)) for x in model.intercepts]), span["order"])
    for i, w in enumerate(model.weights):
        z = z + F.lit(float(w)) * F.getbit(span["bits"].cast("long"), F.lit(i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _backed(votes: Column) -> Column:
    """Whether more labelers vote for it than against it."""
    balance = F.lit(0)
    for i in range(len(LABELERS)):
        balance = balance + F.floor(votes / 3**i).cast("int") % 3 - 1
    return balance > 0


def spans(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: ``doc_id`` and ``spans``, an array of ``(start, order, end, kind, fixed, probability)``."""
    found = cut(candidates(documents))
    model = fit(found)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    scored = F.transform(
        "found",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["order"].alias("order"),
            s["end"].alias("end"),
            F.get(names, s["order"]).alias("kind"),
            s["fixed"].alias("fixed"),
            _probability(s, model).alias("probability"),
            (s["free"] & _backed(s["votes"])).alias("open"),
        ),
    )
    chosen = F.filter(scored, lambda s: s["fixed"] | (s["open"] & (s["probability"] >= threshold)))
    return found.select("doc_id", F.transform(chosen, lambda s: s.dropFields("open")).alias("spans"))


def find(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and digests of the spans of every document row."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, line), ",")
    return spans(documents, threshold).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in FIXED],
        F.sha2(joined(F.filter("spans", lambda s: s["fixed"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
