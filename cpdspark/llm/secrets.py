"""Find and mask secrets in texts, with DataFrame functions only.

Three base kinds are patterns with a least length (``assign``, ``access``, ``hex``). The kind
``entropy`` slides a window over candidate strings: runs of key characters. Each candidate belongs to
a character class (digits, hex, letters and digits, base 64), and the class has its own threshold. The
window keeps a count per character; a step raises one count, lowers another, and mends the sum of
``c * log2(c)`` with the two changes, so a step costs the same for any window. A run is cut at its slashes:
each segment is judged alone, and what is left of the run without segments that are names is judged as a
whole, so a key is found behind a path and with slashes inside. The allow list suppresses whole segments only.
Suppressed are also runs that a base span covers, and paths of the reserved hosts example.com, .net and .org.

Positions are code points, end exclusive, of the whole match. Matches are marked inside the text by
two control characters, which no pattern can match; where the text has them itself, another control
character of the same length stands in for them while spans are sought.

Defined cases: a null text counts as empty when spans are sought and stays null when masked; each row
is its own unit, so null or repeated doc_ids and repeated rows need no rule; an empty table gives no
rows; columns other than doc_id and text pass through ``mask`` and are left out by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

_ON, _OFF, _OTHER = "\u0001", "\u0002", "\u0003"

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]+)"
CANDIDATE = r"((?:https?://(?:www\.)?example\.(?:com|net|org)/)?)([A-Za-z0-9+/_=-]+)"
MASK = "[masked]"

_WORD = r"(?:[A-Z]{1,19}|[A-Z]?[a-z]{1,19}|[A-Z]?[a-z]{2,19}(?:[A-Z][a-z]{1,19})+)"


@dataclass(frozen=True)
class EntropyRule:
    """Window length, and bits per character from which a window is suspicious, by character class."""

    window: int = 20
    digits: float = 2.6
    hexadecimal: float = 3.0
    letters: float = 3.75  # above long words
    mixed: float = 3.6
    base64: float = 3.8
    #: Segments that are words, one character repeated, or a UUID.
    allow: str = rf"^_*{_WORD}(?:[_=-]+{_WORD})*_*$|^(.)\1+$|(?i:^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$)"
    #: Segments of a path: words with short numbers, and numbers.
    names: str = rf"^(?=.{{4}})_*(?:{_WORD}[0-9]{{0,4}}|[0-9]+)(?:[_=-]+(?:{_WORD}[0-9]{{0,4}}|[0-9]+))*_*$"


@dataclass(frozen=True)
class _Kind:
    name: str
    order: int
    pattern: str
    least: int  # of group 2, in characters


KINDS = (_Kind("assign", 0, ASSIGN, 6), _Kind("access", 1, ACCESS, 20), _Kind("hex", 2, HEX, 24))


def _marked(text: Column, pattern: str) -> Column:
    """Split at matches: the text before the first one, then ``group 1, OFF, group 2, OFF, gap`` for each."""
    return F.split(F.regexp_replace(text, pattern, f"{_ON}$1{_OFF}$2{_OFF}"), _ON)


def _plain(text: Column) -> Column:
    return F.translate(text, _ON + _OFF, _OTHER + _OTHER)


def _entropy(run: Column, window: int) -> Column:
    """Greatest entropy, in bits, of any ``window`` characters of ``run``; 0 for shorter runs."""
    first, letters = 43, 80  # '+' to 'z'
    code = F.transform(F.split(run, ""), lambda ch: F.ascii(ch) - first)
    log = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), letters).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(codes: Column):
        def one(state: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            up = F.get(state["n"], new)
            down = F.when(old >= 0, F.get(state["n"], old)).otherwise(F.lit(0))
            same = new == old
            s = F.when(same, state["s"]).otherwise(
                state["s"] + log(up + 1) - log(up) + F.when(old >= 0, log(down - 1) - log(down)).otherwise(F.lit(0.0))
            )
            n = F.when(same, state["n"]).otherwise(
                F.transform(state["n"], lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"))
            )
            bits = F.log2(F.lit(float(window))) - s / window
            best = F.when(i >= window - 1, F.greatest(state["best"], bits)).otherwise(state["best"])
            return F.struct(n.alias("n"), s.alias("s"), best.alias("best"))

        return one

    steps = F.sequence(F.lit(0), F.length(run) - 1)
    # aggregate() over an array of one holds the codes, so that they are computed once for a run
    best = F.aggregate(F.array(code), F.lit(0.0), lambda _, codes: F.aggregate(steps, start, step(codes), lambda s: s["best"]))
    return F.when(F.length(run) >= window, best).otherwise(F.lit(0.0))


def _threshold(run: Column, rule: EntropyRule) -> Column:
    return (
        F.when(run.rlike("^[0-9]+$"), rule.digits)
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), rule.hexadecimal)
        .when(run.rlike("^[A-Za-z]+$"), rule.letters)
        .when(run.rlike("^[A-Za-z0-9]+$"), rule.mixed)
        .otherwise(rule.base64)
    )


def _suspicious(run: Column, rule: EntropyRule) -> Column:
    def key(part: Column) -> Column:
        kinds = part.rlike("[0-9]") | part.rlike("^[A-Za-z]+$") | (part.rlike("[a-z]") & part.rlike("[A-Z]"))
        high = _entropy(part, rule.window) >= _threshold(part, rule)
        return (F.length(part) >= rule.window) & ~part.rlike(rule.allow) & kinds & high

    unnamed = F.filter(F.split(run, "/"), lambda s: (s != "") & ~s.rlike(rule.names))
    joined = F.when(F.contains(run, F.lit("/")), F.array(F.array_join(unnamed, "/"))).otherwise(F.array().cast("array<string>"))
    return F.exists(F.concat(F.split(run, "/"), joined), key)


def _parts(piece: Column) -> tuple[Column, Column, Column]:
    """Group 1, group 2 and the gap of a piece of ``_marked``; the first piece is all gap."""
    a = F.split(piece, _OFF)
    return F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2))


def _pieces(text: Column, kind: str, order: int, pattern: str, least: int) -> Column:
    """Lengths only: ``(order, kind, i, total, match, run)`` for each piece; a failing match is a gap."""

    def one(piece: Column, i: Column) -> Column:
        head, body, gap = _parts(piece)
        is_match = (i > 0) & (F.length(body) >= least) & (F.lit(kind != "entropy") | (head == ""))
        total = F.when(i > 0, F.length(head) + F.length(body) + F.length(gap)).otherwise(F.length(piece))
        return F.struct(
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            i.alias("i"),
            total.cast("long").alias("total"),
            F.when(is_match, F.length(head) + F.length(body)).cast("long").alias("match"),
            (F.when(is_match, body) if kind == "entropy" else F.lit(None).cast("string")).alias("run"),
        )

    return F.transform(_marked(text, pattern), one)


def spans(documents: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per document row: ``doc_id`` and ``spans``, an array of ``(start, order, kind, end)``.

    The texts stay where they are: only lengths of pieces of texts with a match are shuffled.
    """
    seeking = [(k.name, k.order, k.pattern, k.least) for k in KINDS] + [("entropy", 3, CANDIDATE, rule.window)]
    text = F.col("_text")
    none = F.array().cast("array<struct<order:int,kind:string,i:int,total:long,match:long,run:string>>")
    hits = [
        F.when(text.rlike(_least(p, n)), _pieces(text, kind, order, p, n)).otherwise(none)
        for kind, order, p, n in seeking
    ]
    rows = documents.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", _plain(F.coalesce("text", F.lit(""))).alias("_text")
    )
    pieces = rows.select("_row", "doc_id", F.explode_outer(F.concat(*hits)).alias("p")).select("_row", "doc_id", "p.*")
    after = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.repartition("_row").withColumn("start", F.coalesce(F.sum("total").over(after), F.lit(0)))
    span = F.struct("start", "order", "kind", (F.col("start") + F.col("match")).alias("end"), "run")
    grouped = placed.groupBy("_row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("match").isNotNull(), span))).alias("_all")
    )
    base = F.filter("_all", lambda s: s["kind"] != "entropy")
    # a run that only overlaps base spans, as a key with hex digits inside, is reported whole beside them
    apart = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    chosen = grouped.withColumn("_base", base).select(
        "doc_id",
        F.filter(
            "_all", lambda s: (s["kind"] != "entropy") | (apart(s) & _suspicious(s["run"], rule))
        ).alias("_all"),
    )
    return chosen.select("doc_id", F.transform("_all", lambda s: s.dropFields("run")).alias("spans"))


def _least(pattern: str, least: int) -> str:
    """Whether a text can have a match that does not fail: cheap to refute."""
    fixed = len("AKIA") if pattern == ACCESS else 0  # what group 2 has before its repeated class
    return pattern[: pattern.rindex("+)")] + "{" + str(least - fixed) + "})"


def find(documents: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Counts and digests of the spans of every document row."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, line), ",")
    return spans(documents, rule).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _masked(text: Column, pattern: str, bad) -> Column:
    """``text`` with the matches masked whose groups are ``bad``."""

    def one(piece: Column, i: Column) -> Column:
        head, body, gap = _parts(piece)
        kept = F.when(bad(head, body), F.lit(MASK)).otherwise(F.concat(head, body))
        return F.when(i == 0, piece).otherwise(F.concat(kept, gap))

    return F.array_join(F.transform(_marked(text, pattern), one), "")


def mask(documents: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Every row, its secrets replaced by ``[masked]``; ``n_chars`` follows. No shuffle.

    Assignments go first, then runs of high entropy as wholes, then what access keys and hex digits are left.

    Texts without a secret stay as they are, to the byte. Where secrets are masked, the two marking
    characters, if a text has them, become another control character.
    """
    out, columns = documents, documents.columns

    def base(out: DataFrame, k: _Kind) -> DataFrame:
        longer = F.col("text").rlike(_least(k.pattern, k.least))
        masked = _masked(_plain(F.col("text")), k.pattern, lambda _, body: F.length(body) >= k.least)
        return out.withColumn("text", F.when(longer, masked).otherwise(F.col("text")))

    out = base(out, KINDS[0])
    # before access keys and hex digits, which may lie inside a longer key
    longer = F.col("text").rlike(_least(CANDIDATE, rule.window))
    found = _masked(_plain(F.col("text")), CANDIDATE, lambda head, body: (head == "") & _suspicious(body, rule))
    out = out.withColumn("text", F.when(longer & F.contains(found, F.lit(MASK)), found).otherwise(F.col("text")))
    for k in KINDS[1:]:
        out = base(out, k)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in columns])
