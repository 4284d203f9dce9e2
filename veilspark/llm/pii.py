"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans. Five labelers (strict pattern, checksum or range, gazetteer, context words for,
context words against) each vote yes, no or nothing on every span. Expectation-maximisation over the table of vote
patterns (at most 3^5 rows, however many spans there are) estimates each labeler's reliability, and with
it a posterior for each span. A naive Bayes classifier on the span's own features (kind, length, number of digits,
neighbouring characters, cue words nearby) is then trained on these posteriors by plain sums, and has the last word on spans of the
added kinds. Spans of the four base kinds follow their definitions and always stay.

Positions are code points. They follow from splitting the text at a pattern's matches: a match begins after
the pieces and matches before it.

The patterns take no second look at a run of characters: where a match could only begin at the start of a
run, a look-behind says so, and repeats are possessive, so that very long runs cost linear time.

Defined results: null texts count as empty and have no spans; repeated rows repeat their result; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut, text_or_empty

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["name", "national_id", "local_phone", "iban"]

# What proposes spans.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. ?[A-Z][a-z]++(?: [A-Z][a-z]++)?+|(?<=[Mm]y name is )[A-Z][a-z]++(?: [A-Z][a-z]++)?+",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b(?![.-]?[0-9])",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])(?![.-][0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+\b",
}
# A cheap test that a text may have a match at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.contains("+"),
    "name": lambda t: t.rlike(r"(?:Mr|Ms|Dr|Prof|Mrs)\.|[Mm]y name is "),
}
# Strict forms, gazetteers and context words of the labelers.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?[ .-]?[0-9]",
    "name": r"^(?:\w+\. ?)?[A-Z][a-z]{2,}",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9][0-9]{2}",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}$",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "phone": r"^\+(?:1|33|34|44|49|39|31|32|41|43|81|86|91)",
    "name": r"(?:Alice|Anna|Bob|Carlos|Daniel|David|Emily|Emma|George|Jack|Jane|John|Julia|Laura|Maria|Mark|Mary|Michael|Peter|Robert|Sarah|Susan|Thomas)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "card": r"^(?:4|5[1-5])",
}
CUES_FOR = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|ip|address|host|card|visa|mastercard|account|iban|ssn|social security|name|patient|born)\b[^.!?]*$"
CUES_AGAINST = r"(?i)\b(?:version|isbn|issn|section|figure|chapter|example|serial|build|part no|invoice|page)\b[^.!?]*$"

VOTERS = ["strict", "check", "gazetteer", "cue_for", "cue_against"]
SPAN = "struct<kind:string,start:bigint,stop:bigint,found:string,before:string,after:string>"


def _spans(kind: str, text: Column) -> Column:
    """Array of spans of one pattern, by start."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    starts = F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("gap"), F.length(f).alias("own"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["own"]).cast("bigint").alias("at"), F.array_append(a["out"], (a["at"] + x["gap"]).cast("bigint")).alias("out")),
        lambda a: a["out"],
    )
    rows = F.transform(
        F.arrays_zip(starts.alias("at"), found.alias("found"), F.slice(pieces, 1, F.size(found)).alias("before"), F.slice(pieces, F.lit(2), F.size(found)).alias("after")),
        lambda z: F.struct(F.lit(kind).alias("kind"), z["at"].alias("start"), (z["at"] + F.length(z["found"])).cast("bigint").alias("stop"), z["found"].alias("found"), F.right(z["before"], F.lit(60)).alias("before"), F.left(z["after"], F.lit(16)).alias("after")),
    )
    gate = GATES.get(kind, lambda t: t.rlike(pattern))
    return F.when(gate(text), rows).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid(span: Column) -> Column:
    """The base kinds' own conditions; others stand as proposed."""
    n = F.length(_digits(span["found"]))
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(span["kind"] == "ip", span["found"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(span["kind"] == "card", n.between(16, 19) & F.call_function("luhn_check", _digits(span["found"])))
        .when(span["kind"] == "phone", n.between(8, 15))
        .otherwise(F.lit(True))
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans. Added ones that overlap a base one, or an added one before, are gone."""
    text = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    x = text.select("doc_id", *(F.filter(_spans(k, F.col("text")), _valid).alias(k) for k in [*BASE_KINDS, *ADDED_KINDS]))
    x = x.select("doc_id", F.concat(*BASE_KINDS).alias("base"), F.concat(*ADDED_KINDS).alias("more"))
    free = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return x.select("doc_id", "base", F.filter(free, lambda s: ~F.exists(free, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]) & (o["stop"] - o["start"] > s["stop"] - s["start"]))).alias("added"))


def votes(span: Column) -> dict[str, Column]:
    """1 for, 0 against, null for no vote."""
    by_kind = lambda table, value: F.coalesce(*(F.when((span["kind"] == k) & span["found"].rlike(p), F.lit(value)) for k, p in table.items()))
    n = F.length(_digits(span["found"]))
    return {
        "strict": F.coalesce(by_kind(STRICT, 1), F.lit(0)),
        "check": F.when(span["kind"] == "card", F.call_function("luhn_check", _digits(span["found"])).cast("int"))
        .when(span["kind"] == "ip", F.when(span["found"].rlike(r"^(?:0|127|255)\."), 0).otherwise(1))
        .when(span["kind"].isin("phone", "local_phone"), n.between(9, 13).cast("int"))
        .when(span["kind"] == "national_id", F.when(span["found"].rlike(r"^(?:123-45-6789|000|666|9)"), 0).otherwise(1)),
        "gazetteer": by_kind(GAZETTEER, 1),
        "cue_for": F.when(span["before"].rlike(CUES_FOR), F.lit(1)),
        "cue_against": F.when(span["before"].rlike(CUES_AGAINST), F.lit(0)),
    }


def features(span: Column) -> dict[str, Column]:
    """Small categorical features of a span; each has a fixed number of values."""
    n = F.length(span["found"])
    edge = lambda c: F.when(c == "", "edge").when(c.rlike("^[A-Za-z]$"), "letter").when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^\s$"), "blank").otherwise("mark")
    return {
        "kind": span["kind"],
        "length": F.least(F.floor(n / 4), F.lit(12)).cast("string"),
        "digits": F.least(F.length(_digits(span["found"])), F.lit(20)).cast("string"),
        "left": edge(F.right(span["before"], F.lit(1))),
        "right": edge(F.left(span["after"], F.lit(1))),
        "cue": F.when(span["before"].rlike(CUES_FOR), "for").when(span["before"].rlike(CUES_AGAINST), "against").otherwise("none"),
        "strict": F.coalesce(*(F.when((span["kind"] == k) & span["found"].rlike(p), F.lit("yes")) for k, p in STRICT.items()), F.lit("no")),
    }


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[float, list[list[float]]]:
    """EM over (votes, number of spans): the share of personal data, and for each labeler the probability of a yes
    given personal data and given none. Starting values trust the labelers; counts are smoothed with one vote."""
    share = 0.7
    yes = [[0.9, 0.3], [0.9, 0.3], [0.9, 0.3], [0.9, 0.3], [0.9, 0.3]]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        post = [posterior(share, yes, v) for v, _ in patterns]
        good = sum(p * n for p, (_, n) in zip(post, patterns))
        share = min(0.99, max(0.01, (good + 7) / (total + 10)))
        for j in range(len(VOTERS)):
            for c in (0, 1):
                weight = [(n * (p if c == 0 else 1 - p), v[j]) for p, (v, n) in zip(post, patterns) if v[j] is not None]
                first = 0.9 if c == 0 else 0.3
                yes[j][c] = (sum(w for w, v in weight if v) + 10 * first) / (sum(w for w, _ in weight) + 10)
    return share, yes


def posterior(share: float, yes: list[list[float]], vote: tuple[int | None, ...]) -> float:
    z = math.log(share / (1 - share))
    for (a, b), v in zip(yes, vote):
        if v is not None:
            z += math.log(a / b) if v else math.log((1 - a) / (1 - b))
    return 1 / (1 + math.exp(-z))


def _posterior(span: Column, share: float, yes: list[list[float]]) -> Column:
    z = F.lit(math.log(share / (1 - share)))
    for (name, v), (a, b) in zip(votes(span).items(), yes):
        z = z + F.when(v == 1, math.log(a / b)).when(v == 0, math.log((1 - a) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def train(spans: DataFrame) -> tuple[float, dict[str, dict[str, float]]]:
    """Base log-odds and, for each feature's value, its log-odds. spans has a column span. The two tables that reach
    the driver have at most 3^5 rows, and as many as the features have values together."""
    s = F.col("span")
    v = votes(s)
    table = spans.select(*(c.alias(n) for n, c in v.items())).groupBy(*v).count().collect()
    share, yes = reliabilities([(tuple(r[n] for n in VOTERS), r["count"]) for r in table])
    f = features(s)
    soft = spans.select(_posterior(s, share, yes).alias("p"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in f.items()))).alias("f"))
    rows = soft.groupBy("f.feature", "f.value").agg(F.sum("p").alias("good"), F.sum(1 - F.col("p")).alias("bad")).collect()
    good = sum(r.good for r in rows if r.feature == "kind")
    bad = sum(r.bad for r in rows if r.feature == "kind")
    weights: dict[str, dict[str, float]] = {n: {} for n in f}
    for r in rows:
        weights[r.feature][r.value] = round(math.log((r.good + 1) / (good + 20)) - math.log((r.bad + 1) / (bad + 20)), 9)
    return round(math.log((good + 1) / (bad + 1)), 9), weights


def score(span: Column, model: tuple[float, dict[str, dict[str, float]]]) -> Column:
    base, weights = model
    z = F.lit(base)
    for n, c in features(span).items():
        x = F.lit(0.0)
        for value, w in sorted(weights[n].items()):
            x = F.when(c == value, w).otherwise(x)
        z = z + x
    return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), z))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """(doc_id, base, added): spans of the base kinds, and those added ones that the classifier keeps."""
    found = cut(proposals(docs, id_col, text_col))
    model = train(found.select(F.explode(F.concat("base", "added")).alias("span")))
    return found.select("doc_id", "base", F.filter("added", lambda s: score(s, model) >= keep_at).alias("added"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (unique ids) with all found spans replaced by their kind in angle brackets."""
    spans = personal_data(docs, id_col, text_col)
    x = docs.join(spans.select(F.col("doc_id").alias("__id"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias("__spans")), docs[id_col] == F.col("__id"), "left")
    text = text_or_empty(docs[text_col])
    done = F.aggregate(
        F.coalesce("__spans", F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))),
    )
    return x.withColumn(text_col, F.when(docs[text_col].isNotNull(), done)).drop("__id", "__spans")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))
