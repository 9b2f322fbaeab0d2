"""Personal data by weak supervision, in DataFrame expressions alone.

Regular expressions, gazetteers and context labelers each vote on every candidate span. The votes
come in few patterns, which are counted over all documents; expectation-maximisation on the counts
estimates how reliable each labeler is and how likely each pattern is a true span; those soft labels
train a logistic span classifier. Spans by the four base patterns always stay; the classifier decides
on the further candidates (loose forms of the same four kinds).

Start positions come from what lies between matches: split and extraction walk the same matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import spare, table, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive loops and a look behind so that long runs take linear time; they
#: match what the plain forms match: a match starts where a run starts, or at the last match's end.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Loose forms: written-out addresses, addresses of eight groups, cards with dots, phones without a plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[({]dot[\])}]\x20?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+.A-Za-z-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.A-Za-z-])",
}
#: Gazetteers: ends of domains, first digits of card numbers, country codes; words that announce a span.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {"email": "mail|contact|write|adress|correo|courriel", "ip": "\\bip\\b|host|server|address|login|from", "card": "card|visa|karte|carte|tarjeta|payment", "phone": "call|phone|tel|fax|mobil|appel|llam|ruf"}
#: Characters before a span in which a cue may stand.
NEAR = 48
VOTES = ("shape", "gazetteer", "context", "edges")
#: The bit that marks a loose candidate: the shape labeler, which knows base matches alone, abstains.
LOOSE_BIT = 1 << len(VOTES)


def _found(text: Column, pattern: str, gate: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _running(x: Column, add: Callable = lambda a, b: a + b) -> Column:
    """Running sums (or what `add` makes) of an array, itself included: in steps that double, so that an array
    of n takes n log n, not n * n."""

    def step(acc: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i < by, v).otherwise(add(v, F.element_at(acc, F.greatest(i - by + 1, F.lit(1))))))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int")), x, step)


def _before(x: Column, first: int) -> Column:
    """An array moved by one place: the element before each, `first` for the first."""
    return F.slice(F.concat(F.array(F.lit(first)), x), F.lit(1), F.size(x))


def _starts(text: Column, pattern: str, hits: Column) -> Column:
    """0-based starts, in code points, of the matches `hits` of the pattern."""
    size = F.transform(hits, lambda h: F.length(h))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.length(g))
    return F.when(F.size(hits) > 0, _running(F.zip_with(gaps, _before(size, 0), lambda g, h: g + h))).otherwise(F.array().cast("array<int>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit of 16 to 19 digits is right."""

    def add(acc: Column, d: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(n)).alias("sum"), (~acc["odd"]).alias("odd"))

    each = F.split(F.reverse(digits), "")
    zero = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.length(digits).between(16, 19) & (F.aggregate(each, zero, add, lambda acc: acc["sum"]) % 10 == 0)


def _valid(kind: str, hit: Column) -> Column:
    """The base rule on a match."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _gazetteer(kind: str, hit: Column) -> Column:
    if kind == "email":
        return hit.rlike(rf"(?i)(?:\.|dot[\])}}]\x20?)(?:{DOMAINS})$")
    if kind == "ip":
        return ~hit.rlike(r"^(?:0|255)\.")
    if kind == "card":
        return _digits(hit).rlike(ISSUERS)
    return hit.rlike(COUNTRIES) | hit.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?\x20?[2-9]")


def _spans(text: Column, kind: str, hits: Column, starts: Column, base: bool) -> Column:
    """Candidates: struct of kind, start, end, base (by its rule), votes as bits in the order of VOTES."""
    k = KINDS.index(kind)

    def one(x: Column) -> Column:
        hit, start = x["hit"], x["start"]
        end = start + F.length(hit)
        before = F.substring(text, F.greatest(start - NEAR + 1, F.lit(1)), F.least(start, F.lit(NEAR)))
        edge = F.concat(F.substring(text, start, F.when(start > 0, 1).otherwise(0)), F.lit("|"), F.substring(text, end + 1, F.lit(1)))
        ok = _valid(kind, hit) if base else F.lit(False)
        votes = [ok, _gazetteer(kind, hit), before.rlike(f"(?i){CUES[kind]}"), ~edge.rlike(r"[\p{L}\p{N}_/=#]\||\|[\p{L}\p{N}_/=@]")]
        bits = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(votes)), F.lit(0 if base else LOOSE_BIT))
        return F.struct(F.lit(k).alias("kind"), start.alias("start"), end.alias("end"), ok.alias("base"), bits.alias("votes"))

    return F.transform(F.arrays_zip(hits.alias("hit"), starts.alias("start")), one)


_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int>>"


def candidates(docs: DataFrame, name: str = "_spans") -> DataFrame:
    """docs with `name` behind its columns: all candidates of the text (null: empty), base matches first. A row per row,
    repeated ones too; an empty table gives none; a long text is taken whole, in steps that grow with it."""
    own = spare("_h", [c[:2] for c in docs.columns])
    t = F.coalesce(F.col("text"), F.lit(""))
    at, dots = t.contains("@"), t.rlike(r"[0-9]\.[0-9]")
    base = {"email": (EMAIL, at), "ip": (IP, dots), "card": (CARD, t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")), "phone": (PHONE, t.contains("+"))}
    loose = {"email": (LOOSE["email"], t.rlike(r"[\[({]at[\])}]")), "ip": (LOOSE["ip"], t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]")), "card": (LOOSE["card"], dots), "phone": (LOOSE["phone"], t.rlike(r"[0-9]{3}[.-][0-9]{4}"))}
    cols = [f"`{c}`" for c in docs.columns]
    every = [(f"{own}{i}{k}", k, b, p, g) for i, (b, group) in enumerate(((True, base), (False, loose))) for k, (p, g) in group.items()]
    rows = docs.select(*cols, *(_found(t, p, g).alias(n) for n, _, _, p, g in every))
    rows = rows.select(*cols, *(n for n, *_ in every), *(_starts(t, p, F.col(n)).alias(f"{n}s") for n, _, _, p, _ in every))
    spans = F.concat(*(_spans(t, k, F.col(n), F.col(f"{n}s"), b).cast(_SPAN) for n, k, b, _, _ in every))
    return rows.select(*cols, spans.alias(name))


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """(kind, votes, n) to the probability that such a span is a true one, by expectation-maximisation
    over each labeler's rate of voting for true and for false spans and each kind's share of true ones.
    A labeler that abstains counts neither way; each starts as right four times in five."""
    m = len(VOTES)
    voters = lambda v: range(1 if v & LOOSE_BIT else 0, m)
    true = {(k, v): sum(v >> j & 1 for j in voters(v)) / len(voters(v)) for k, v, _ in counts}
    for _ in range(rounds):
        share: dict[int, list[float]] = {}
        hit, miss, total, wrong = [8.0] * m, [2.0] * m, [10.0] * m, [10.0] * m
        for k, v, n in counts:
            p = true[k, v]
            s = share.setdefault(k, [1.0, 2.0])
            s[0] += n * p
            s[1] += n
            for j in voters(v):
                on = v >> j & 1
                hit[j] += n * p * on
                miss[j] += n * (1 - p) * on
                total[j] += n * p
                wrong[j] += n * (1 - p)
        for k, v, _ in counts:
            odds = math.log(share[k][0]) - math.log(share[k][1] - share[k][0])
            for j in voters(v):
                a, b = hit[j] / total[j], miss[j] / wrong[j]
                odds += math.log(a / b) if v >> j & 1 else math.log((1 - a) / (1 - b))
            true[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return true


def _active(k: int, v: int) -> list[int]:
    """Features of a pattern: its kind, and for each vote its number; behind them, one for a shape that is
    voted down and one for a shape labeler that abstains."""
    base = len(KINDS)
    shape = [base + len(VOTES) + 1] if v & LOOSE_BIT else [] if v & 1 else [base + len(VOTES)]
    return [k, *(base + j for j in range(len(VOTES)) if v >> j & 1), *shape]


def classifier(counts: list[tuple[int, int, int]], steps: int = 600) -> tuple[float, ...]:
    """Weights of the span classifier (see _active()): logistic regression on the soft labels of
    reliabilities(), each pattern weighing the root of its number. Without a kind's spans its weight
    is 0."""
    soft = reliabilities(counts)
    w = [0.0] * (len(KINDS) + len(VOTES) + 2)
    weight = {(k, v): math.sqrt(n) for k, v, n in counts}
    total = sum(weight.values()) or 1.0
    for _ in range(steps):
        g = [0.01 * x for x in w]
        for k, v, _ in counts:
            on = _active(k, v)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on)))))
            for i in on:
                g[i] += (p - soft[k, v]) * weight[k, v] / total
        w = [x - 2.0 * y for x, y in zip(w, g, strict=True)]
    return tuple(w)


def fit(rows: DataFrame) -> tuple[float, ...]:
    """Weights from the vote patterns of all rows with `_spans`. Patterns number 128 at most, so their
    counts may come to the driver."""
    s = rows.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.votes").count()
    return classifier(sorted((r["kind"], r["votes"], r["count"]) for r in s.collect()))


def accepted(spans: Column, weights: tuple[float, ...]) -> Column:
    """The base spans, and those further candidates that the classifier accepts and that overlap no base
    span; sorted by kind, then start."""
    base = F.filter(spans, lambda s: s["base"])
    k = F.array(*(F.lit(x) for x in weights[: len(KINDS)]))

    def wanted(s: Column) -> Column:
        z = F.element_at(k, s["kind"] + 1)
        for j, x in enumerate(weights[len(KINDS) : len(KINDS) + len(VOTES)]):
            z = z + F.when(s["votes"].bitwiseAND(F.lit(1 << j)) > 0, x).otherwise(0.0)
        z = z + F.when(s["votes"].bitwiseAND(F.lit(LOOSE_BIT)) > 0, weights[-1]).when(s["votes"].bitwiseAND(F.lit(1)) == 0, weights[-2]).otherwise(0.0)
        apart = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["base"] | ((z >= 0) & apart)

    return F.array_sort(F.transform(F.filter(spans, wanted), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """rows with `_spans` to doc_id, the counts of base spans, base_sha256 and spans. Rows without spans have counts of
    0, the hash of the empty text and no spans; null ids, repeated rows and empty tables stay as they are."""
    base = F.array_sort(F.transform(F.filter("_spans", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    of = lambda i: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    n = (of(i).alias(f"n_{k}") for i, k in enumerate(KINDS))
    return rows.select("doc_id", *n, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(accepted(F.col("_spans"), weights)).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets (spans that overlap, by
    the kind of the first, of equal starts the longest); n_chars, if there is such a column, follows. Null
    texts stay null. All other columns stay, whatever their names; repeated rows are masked each, an empty
    table gives no rows. The candidates are sought once: documents and spans are a table in between."""
    cols, s, t = docs.columns, spare("spans", docs.columns), spare("masks", docs.columns)
    rows = written(candidates(docs, s), "masking")
    weights = fit(rows.select(F.col(s).alias("_spans")))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("text")
    spans = F.array_sort(F.transform(accepted(F.col(s), weights), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["end"].alias("end"), x["kind"].alias("kind"))))
    # each with the end of all before it: what starts earlier is part of an earlier span
    ends = _running(F.transform(F.col(t), lambda x: x["end"]), F.greatest)
    pairs = F.filter(F.arrays_zip(F.col(t).alias("span"), _before(ends, 0).alias("at")), lambda p: p["span"]["start"] >= p["at"])
    parts = F.transform(pairs, lambda p: F.concat(F.substring(text, p["at"] + 1, p["span"]["start"] - p["at"]), F.element_at(names, p["span"]["kind"] + 1)))
    new = F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(F.col(t), lambda x: x["end"])) + 1, F.length(text)))
    rows = rows.select(*(F.col(f"`{c}`") for c in cols), spans.alias(t))
    out = rows.select(*(F.when(F.size(t) > 0, new).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in cols))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    rows = written(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans"), "spans")
    return found(rows, fit(rows))


QUERIES: dict[str, Callable] = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
