"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans; four labelers vote on each (for, against or abstaining): its form, gazetteers of top-level
domains, calling codes, card prefixes and first names, the words before it, and whether it stands
alone. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how
likely each pattern is personal data; with these probabilities as soft targets a logistic span classifier is
trained, which also sees kind, length and digits. Spans of the base kinds that pass their checks are always kept;
the classifier decides on all other proposals.

Each text is scanned once; proposals go to a stored table without the text. The number of vote patterns is bounded
by the labelers (see ``_PATTERN``), so the driver fits both models on that many counts, whatever the table's size.
Positions come from splitting a text at the matches: what lies between them and the matches add up.

Defined results: a null text is empty and has no spans; a null id stays null; repeated rows get a row each; an empty
table gives an empty result and models that keep base spans only. Only the named columns are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm.common import free_names, table
from trailmetrics.session import materialise

#: The base kinds in the order in which they are listed, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "secret", "name")
#: The base patterns. Possessive where nothing could follow, and begun only where a run of the
#: characters begins, so that no text takes more than linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[ .-]{1,2})(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "secret": r"(?<=(?:password|passwd|token|secret|api_key|apikey)[ ]{0,2}[:=][ ]{0,2}[\"']?)[A-Za-z0-9_+/-]{12,}",
    "name": r"(?<=(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? )[A-Z][a-z]++(?: [A-Z][a-z]++)?+",
}
#: What a text needs for a pattern to be tried at all.
_NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9]"),
    "phone": lambda text: F.contains(text, F.lit("+")),
    "local_phone": lambda text: text.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    "secret": lambda text: text.rlike(r"(?:word|passwd|token|secret|key) {0,2}[:=]"),
    "name": lambda text: text.rlike(r"(?:Mrs?|Ms|Dr|Prof)\.? [A-Z]"),
}
TOP_DOMAINS = "com org net edu gov info io co de fr es uk us eu it nl ch at be ca au jp br mx".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91 351 353 358".split()
FIRST_NAMES = "james john robert michael david mary linda anna maria peter thomas hans marie pierre jean carlos jose".split()
CUES = r"(?i)(?:mail|write|contact|phone|call|tel|mobil|fax|from|address|server|host|card|visa|pay|account|password|passwd|token|secret|key|mr|mrs|ms|dr|prof)\W{0,4}(?:\w{1,4}\W{1,2})?$"
ANTI_CUES = r"(?i)(?:version|release|isbn|issn|page|chapter|section|order|invoice|serial|part no|build)\W{0,4}$"
AROUND = 24
CHUNK = 256
_PATTERN = ["kind", "form", "gazetteer", "context", "alone", "size", "digits"]
_LABELERS = ("form", "gazetteer", "context", "alone")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def located(text: Column, pattern: str) -> Column:
    """``start, end, found`` of the leftmost matches that do not overlap, in code points."""
    span = "array<struct<start:int,end:int,found:string>>"

    def fold(between: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("gap"), f.alias("found")))
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")),
            lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)),
        )

        def one(state: Column, pair: Column) -> Column:
            start = state["at"] + pair["gap"]
            end = start + F.length(pair["found"])
            spans = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))))
            return F.struct(end.alias("at"), spans.alias("spans"))

        def chunk(state: Column, part: Column) -> Column:  # spans of a chunk apart, so that no long array is copied per match
            begin = F.struct(state["at"].alias("at"), F.array().cast(span).alias("spans"))
            return _let(
                F.aggregate(part, begin, one),
                lambda done: F.struct(done["at"].alias("at"), F.concat(state["spans"], F.array(done["spans"])).alias("spans")),
            )

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
        return F.flatten(F.aggregate(chunks, begin, chunk)["spans"])

    none = F.array().cast(span)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(matches, lambda found: F.when(F.size(found) > 0, fold(F.split(text, pattern), found)).otherwise(none))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _vote(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, 1).when(F.lit(True) if bad is None else bad, -1).otherwise(0)


def _form(kind: str, found: Column) -> Column:
    """Does the span pass the checks of its kind?"""
    digits = _digits(found)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _gazetteer(kind: str, found: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(found, r"\.([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS))
    if kind == "phone":
        return _vote(found.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})[^0-9]") , found.rlike(r"^\+0"))
    if kind == "card":
        return _vote(found.rlike("^[3-6]"))
    if kind == "ip":
        return _vote(found.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."))
    if kind == "name":
        return _vote(F.lower(F.regexp_extract(found, "^[A-Za-z]+", 0)).isin(FIRST_NAMES), F.lit(False))
    return F.lit(0)


def _judge(text: Column, number: int, kind: str) -> Callable[[Column], Column]:
    def judged(span: Column) -> Column:
        start, end, found = span["start"], span["end"], span["found"]
        before = F.substr(text, F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)))
        after = F.substr(text, end + 1, F.lit(1))
        form = _form(kind, found)
        return F.struct(
            start.alias("start"), F.lit(number).alias("kind"), end.alias("end"),
            (form if kind in BASE else F.lit(False)).alias("base"), _vote(form).alias("form"),
            _gazetteer(kind, found).alias("gazetteer"),
            _vote(before.rlike(CUES), before.rlike(ANTI_CUES)).alias("context"),
            _vote(~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")).alias("alone"),
            F.floor(F.least(end - start, F.lit(39)) / 10).cast("int").alias("size"),
            found.rlike("[0-9]").cast("int").alias("digits"),
        )

    return judged


def proposals(text: Column) -> Column:
    """All proposed spans of a text with the votes on them, ordered by start, then kind."""
    everything = []
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    for number, kind in enumerate(KINDS):
        needed = F.when(_NEEDS[kind](text), located(text, PATTERNS[kind]))
        everything.append(F.transform(F.coalesce(needed, none), _judge(text, number, kind)))
    return F.array_sort(F.concat(*everything))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by feature."""

    bias: float
    weights: dict[tuple[str, int], float]

    def accepts(self, span: Column) -> Column:
        score = F.lit(self.bias)
        for (name, value), weight in sorted(self.weights.items()):
            score = score + F.when(span[name] == value, weight).otherwise(0.0)
        return score > 0


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def estimate(patterns: list[dict], rounds: int = 60) -> tuple[list[float], dict]:
    """Expectation-maximisation over counted vote patterns.

    Returns each pattern's probability of being personal data, and each labeler's chance of each vote given the truth.
    Begins with the share of votes in favour; a pseudo-count on the diagonal keeps the two classes from changing places.
    """
    belief = []
    for p in patterns:
        votes = [p[name] for name in _LABELERS if p[name]]
        belief.append(min(0.95, max(0.05, sum(v > 0 for v in votes) / len(votes))) if votes else 0.5)
    table: dict = {}
    for _ in range(rounds):
        prior = {}
        for kind in {p["kind"] for p in patterns}:
            own = [(p["n"], b) for p, b in zip(patterns, belief) if p["kind"] == kind]
            prior[kind] = (1 + sum(n * b for n, b in own)) / (2 + sum(n for n, _ in own))
        for name in _LABELERS:
            for truth in (0, 1):
                weight = {v: 1.0 + 4.0 * (v == (1 if truth else -1)) for v in (-1, 0, 1)}
                for p, b in zip(patterns, belief):
                    weight[p[name]] += p["n"] * (b if truth else 1 - b)
                total = sum(weight.values())
                table[name, truth] = {v: w / total for v, w in weight.items()}
        belief = []
        for p in patterns:
            odds = math.log(prior[p["kind"]] / (1 - prior[p["kind"]]))
            odds += sum(math.log(table[name, 1][p[name]] / table[name, 0][p[name]]) for name in _LABELERS)
            belief.append(_sigmoid(odds))
    return belief, table


def train(patterns: list[dict], belief: list[float], rounds: int = 300) -> SpanModel:
    """Logistic regression on the estimated probabilities, each pattern weighing as the logarithm of its count."""
    features = [[(name, p[name]) for name in _PATTERN] for p in patterns]
    shares = [math.log1p(p["n"]) for p in patterns]
    whole = sum(shares) or 1.0
    weights, bias = {f: 0.0 for fs in features for f in fs}, 0.0
    for _ in range(rounds):
        slopes, slope = {f: 1e-3 * w for f, w in weights.items()}, 0.0
        for fs, share, b in zip(features, shares, belief):
            error = (_sigmoid(bias + sum(weights[f] for f in fs)) - b) * share / whole
            slope += error
            for f in fs:
                slopes[f] += error
        bias -= 2.0 * slope
        for f in weights:
            weights[f] -= 2.0 * slopes[f]
    return SpanModel(bias if patterns else -1.0, weights)


def fit(spans: DataFrame) -> SpanModel:
    """Both models from the votes in the column ``spans``; the driver gets a row per vote pattern."""
    votes = spans.select(F.explode("spans").alias("s")).groupBy(*(F.col("s")[name].alias(name) for name in _PATTERN))
    patterns = sorted((row.asDict() for row in votes.agg(F.count("*").alias("n")).collect()), key=lambda p: [p[name] for name in _PATTERN])
    belief, _ = estimate(patterns)
    return train(patterns, belief)


def kept_spans(spans: Column, model: SpanModel) -> Column:
    return F.filter(spans, lambda span: span["base"] | model.accepts(span))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in order."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark of its kind in place of each span; of spans that overlap, the first names the mark."""
    marks = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))

    def step(state: Column, span: Column) -> Column:
        new = F.concat(F.substr(text, state["at"] + 1, span["start"] - state["at"]), marks[span["kind"]])
        parts = F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(new))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    def begin(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))

    def chunk(state: Column, some: Column) -> Column:
        """A chunk's parts become one, so that no array of all parts is copied for each span."""
        return _let(
            F.aggregate(some, begin(state["at"]), step),
            lambda done: F.struct(done["at"].alias("at"), F.concat(state["parts"], F.array(F.array_join(done["parts"], ""))).alias("parts")),
        )

    last = F.floor((F.size(spans) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(spans, i * CHUNK + 1, CHUNK))
    rest = F.length(text) + 1
    return _let(
        F.aggregate(chunks, begin(F.lit(0)), chunk),
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1, rest)),
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: every kept span of every row as ``start, kind, end, base`` and votes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = materialise(docs.select(F.col(id_col).alias("doc_id"), proposals(text).alias("spans")), "proposals")
    return found.select("doc_id", kept_spans(F.col("spans"), fit(found)).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, with marks in place of personal data; null texts stay null.

    Each text is scanned once: what is found is stored beside it, for the fit and for the marks.
    """
    text, (name,) = F.coalesce(F.col("text"), F.lit("")), free_names(docs.columns, "spans")
    found = materialise(docs.withColumn(name, proposals(text)), "proposals")
    model = fit(found.select(F.col(name).alias("spans")))
    spans = kept_spans(F.col(name), model)
    clean = _let(spans, lambda kept: F.when(F.size(kept) > 0, redacted(text, kept)).otherwise(F.col("text")))
    out = found.withColumn("text", clean).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))) if "n_chars" in docs.columns else out


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda span: span["base"])
    counts = [_count(spans, number).alias(f"n_{kind}") for number, kind in enumerate(BASE)]
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans")
    )


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda span: span["base"] & (span["kind"] == number))).cast("long")
