"""Personal data in whole texts: fixed base patterns plus spans found by weak supervision.

Candidates are the matches of the base patterns, valid or not, and of looser forms (spelled-out
addresses, national phone numbers, long or spaced ip addresses). Three labelers vote on each: the
validity of the form, a gazetteer (domain endings, issuer and area prefixes, reserved nets) and the words before
it. Expectation-maximisation over the counts of vote patterns estimates the labelers' reliabilities. Its posteriors are the
targets of a logistic span classifier with features of its own, none of which a labeler votes by: hashed shapes, affixes and lengths of the
span and the words to its left and right. So it also judges spans that the labelers say little about. Valid base matches always
stay, other candidates are added where the classifier is sure, no base span overlaps and the labelers do not hold them for false.

Everything that touches rows is a DataFrame expression. Only counts of vote patterns (at most 4 kinds x 27 votes x 2 forms) and
one sum per feature slot and round come to the driver.

Defined results: a null or empty text has no spans; repeated rows are treated alike; an empty table
gives no rows; other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import saved
from gradeloom.session import computed_once

KINDS = ("email", "ip", "card", "phone")
# Matches may start only where a run starts or the last match ended; the results are
# the same, but long runs are not tried from each of their characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?: ?(?:\[at\]|\(at\)) ?[a-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[a-z0-9-]{1,63}){1,8}| at [a-z0-9-]{1,63}(?: dot [a-z0-9-]{1,63}){1,8})",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){2} ?\. [0-9]{1,3})(?![0-9A-Fa-f:.])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GATES = {
    ("base", "email"): "contains(text, '@')",
    ("base", "ip"): "dotted",
    ("base", "card"): "digits",
    ("base", "phone"): "contains(text, '+') AND digits",
    ("loose", "email"): "contains(lower(text), '[at]') OR contains(lower(text), '(at)') OR contains(lower(text), ' dot ')",
    ("loose", "ip"): "digits AND (contains(text, ':') OR contains(text, '. '))",
    ("loose", "phone"): "digits",
}
# Fixed values of the gazetteer labeler and the context labeler.
ENDINGS = "com net org edu gov int info biz io de fr es uk it nl eu us ca ch at be".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(0|10|127|255|169\.254|192\.168)\."
CUES = {
    "email": r"\b(mail|e-mail|email|contact|write|correo|courriel)\b",
    "ip": r"\b(ip|address|addr|host|login|logged|client)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|debit|payment|paid|karte|tarjeta|carte)\b",
    "phone": r"\b(tel|phone|telephone|call|mobile|fax|telefon|ring|sms)\b",
}
DENIALS = r"\b(version|release|order|invoice|isbn|serial|part|ref|item|section|chapter|build)\b"
SURE = 0.9
#: Slots of the span classifier's hashed features, and rounds of its training.
SLOTS, ROUNDS = 4096, 12
_BLOCK = 256
_VOTES = ["kind", "form", "by_form", "by_gazetteer", "by_context"]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _starts(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn each ``{name}_pieces`` and ``{name}_found`` into ``{name}``: structs of start, end, match, left.

    A match starts after all pieces and matches before it. Sums are taken over blocks, then within a block,
    so a text with very many matches stays far from quadratic.
    """
    keep = ["doc_id"]
    steps = [
        F.expr(f"""transform({n}_found, (m, i) -> struct(length(m) AS size, length({n}_pieces[i]) AS gap, m AS match,
            lower(right({n}_pieces[i], 40)) AS left, lower(left({n}_pieces[i + 1], 40)) AS right))""").alias(n)
        for n in names
    ]
    df = computed_once(df, keep, *steps)
    blocks = [
        F.expr(f"""transform(sequence(0, CAST(ceil(size({n}) / {_BLOCK}) AS INT)), b ->
            aggregate(slice({n}, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a + x.size + x.gap))""").alias(f"{n}_blocks")
        for n in names
    ]
    df = computed_once(df, keep + names, *blocks)
    offsets = [
        F.expr(f"transform({n}_blocks, (x, b) -> aggregate(slice({n}_blocks, 1, b), 0L, (a, y) -> a + y))").alias(f"{n}_offsets")
        for n in names
    ]
    df = computed_once(df, keep + names, *offsets)
    before = "{n}_offsets[i div 256] + aggregate(slice({n}, (i div 256) * 256 + 1, i % 256), 0L, (a, y) -> a + y.size + y.gap) + x.gap"
    spans = [
        F.expr(f"""transform(transform({n}, (x, i) -> struct({before.format(n=n)} AS start, x.size AS size, x.match AS match, x.left AS left, x.right AS right)),
            x -> struct(x.start AS start, x.start + x.size AS end, x.match AS match, x.left AS left, x.right AS right))""").alias(n)
        for n in names
    ]
    return computed_once(df, keep, *spans)


_DIGITS = "regexp_replace(x.match, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.match, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS INT), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


_GAZETTEER = {
    "email": _vote(rf"rlike(lower(x.match), r'[.)\]] ?({'|'.join(ENDINGS)})$')", "true"),
    "ip": _vote(f"NOT rlike(x.match, r'{RESERVED}')", "true"),
    "card": _vote(f"length({_DIGITS}) BETWEEN 13 AND 19 AND rlike({_DIGITS}, r'{ISSUERS}')", "true"),
    "phone": _vote(f"rlike({_DIGITS}, '^[1-9]?[2-9][0-9]{{2}}[2-9]')", "true"),
}


def _own_features(kind: str) -> str:
    """SQL of the feature slots of a span ``x``: its shape, affixes and length, and the words around it."""
    shape = "regexp_replace(regexp_replace(lower(x.match), '[0-9]', '0'), '[a-z]', 'a')"
    values = {
        "shape": shape,
        "runs": rf"regexp_replace({shape}, r'(.)\1+', '$1')",
        "length": "least(x.end - x.start, 40)",
        **{f"head {k}": f"lower(left(x.match, {k}))" for k in (1, 2, 3)},
        **{f"tail {k}": f"lower(right(x.match, {k}))" for k in (1, 2, 3)},
        "left": r"regexp_extract(x.left, r'([^\s]+)\s*$', 1)",
        "left 2": r"regexp_extract(x.left, r'([^\s]+)\s+[^\s]+\s*$', 1)",
        "touches left": "right(x.left, 1)",
        "right": r"regexp_extract(x.right, r'^\s*([^\s]+)', 1)",
        "touches right": "left(x.right, 1)",
        "all": "''",
    }
    slots = [f"CAST(pmod(xxhash64('{kind}', '{name}', CAST({value} AS STRING)), {SLOTS}) AS INT)" for name, value in values.items()]
    return f"array({', '.join(slots)})"


def _judged(name: str, form: str, kind: str) -> str:
    """SQL of an array of candidates with their votes."""
    valid = _VALID[kind] if form == "base" else "false"
    form_vote = f"CASE WHEN {valid} THEN 1 ELSE -1 END" if form == "base" else "0"
    context = _vote(f"rlike(x.left, {_quoted(CUES[kind])})", f"rlike(x.left, {_quoted(DENIALS)})")
    return f"""transform({name}, x -> struct(x.start AS start, x.end AS end, {valid} AS valid, '{kind}' AS kind, '{form}' AS form,
        {form_vote} AS by_form, {_GAZETTEER[kind]} AS by_gazetteer, {context} AS by_context, {_own_features(kind)} AS slots))"""


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: ``base`` (valid base spans) and ``others`` (all other candidates), with votes."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    gated = computed_once(rows, ["doc_id", "text"], F.expr("rlike(text, '[0-9]')").alias("digits"), F.expr(r"rlike(text, r'[0-9]\.[0-9]')").alias("dotted"))
    found, names = [], []
    for form, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, pattern in patterns.items():
            name, gate, quoted = f"{form}_{kind}", GATES[form, kind], _quoted(pattern)
            names.append(name)
            found.append(F.expr(f"CASE WHEN {gate} THEN split(text, {quoted}, -1) ELSE CAST(array() AS array<string>) END").alias(f"{name}_pieces"))
            found.append(F.expr(f"CASE WHEN {gate} THEN regexp_extract_all(text, {quoted}, 0) ELSE CAST(array() AS array<string>) END").alias(f"{name}_found"))
    placed = _starts(computed_once(gated, ["doc_id"], *found), names)
    judged = [F.expr(_judged(n, *n.split("_"))).alias(n) for n in names]
    placed = computed_once(placed, ["doc_id"], *judged)
    everything = "concat(" + ", ".join(names) + ")"
    both = computed_once(placed, ["doc_id"], F.expr(everything).alias("spans"))
    return both.select(
        "doc_id",
        F.expr("filter(spans, x -> x.valid)").alias("base"),
        F.expr("filter(spans, x -> NOT x.valid)").alias("others"),
    )


def fit_labelers(counts: dict[tuple, int], rounds: int = 100) -> tuple[dict[tuple, float], list[dict]]:
    """Expectation-maximisation over counts of (kind, form, form vote, gazetteer vote, context vote).

    Returns each pattern's posterior of being personal data, and per labeler the probability of each vote
    on real and on false candidates. Labelers start as better than chance and keep a few
    invented votes of that kind, so rare votes stay defined.
    """
    start = [{1: (0.8, 0.2), 0: (0.15, 0.3), -1: (0.05, 0.5)} for _ in range(3)]
    tables, prior = [dict(t) for t in start], dict.fromkeys(KINDS, 0.5)
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            odds = math.log(prior[pattern[0]] / (1 - prior[pattern[0]]))
            odds += sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, pattern[2:]))
            posterior[pattern] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        for k, table in enumerate(tables):
            sums = {v: [10 * p for p in start[k][v]] for v in table}
            for pattern, n in counts.items():
                sums[pattern[2 + k]][0] += n * posterior[pattern]
                sums[pattern[2 + k]][1] += n * (1 - posterior[pattern])
            whole = [sum(s[c] for s in sums.values()) for c in (0, 1)]
            tables[k] = {v: (s[0] / whole[0], s[1] / whole[1]) for v, s in sums.items()}
        for kind in KINDS:
            own = {p: n for p, n in counts.items() if p[0] == kind}
            prior[kind] = (1 + sum(n * posterior[p] for p, n in own.items())) / (2 + sum(own.values()))
    return posterior, tables


def _truth(posterior: dict[tuple, float], name: str) -> str:
    """SQL of the posterior of the struct ``name``, by its votes."""
    votes = f"concat_ws('/', {', '.join(f'{name}.{v}' for v in _VOTES)})"
    cases = "".join(f" WHEN '{'/'.join(map(str, p))}' THEN CAST({q!r} AS DOUBLE)" for p, q in posterior.items())
    return f"CASE {votes}{cases} ELSE CAST(0 AS DOUBLE) END" if cases else "CAST(0 AS DOUBLE)"


def _odds(weights: list[float], name: str) -> str:
    """SQL of the classifier's log odds of the struct ``name``."""
    table = "array(" + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in weights) + ")"
    return f"aggregate({name}.slots, CAST(0 AS DOUBLE), (a, k) -> a + {table}[k])"


def train_classifier(spans: DataFrame, posterior: dict[tuple, float], rounds: int = ROUNDS) -> list[float]:
    """Logistic regression of the posteriors on the spans' own features: a weight per slot.

    ``spans`` has one struct ``x`` a row. Equal spans are counted first; every round is one aggregate over the slots.
    """
    targets = saved(spans.select("x.slots", F.expr(_truth(posterior, "x")).alias("truth")).groupBy("slots", "truth").agg(F.count(F.lit(1)).alias("n")), "targets")
    weights, squares = [0.0] * SLOTS, [1e-3] * SLOTS
    for _ in range(rounds):
        odds = F.aggregate("slots", F.lit(0.0), lambda a, k: a + F.get(F.lit(weights), k))
        error = (1 / (1 + F.exp(-odds)) - F.col("truth")) * F.col("n")
        slopes = targets.select(F.explode("slots").alias("slot"), error.alias("error"), "n").groupBy("slot").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))
        for slot, error, n in slopes.collect():  # at most SLOTS rows
            slope = error / math.sqrt(n) + 0.01 * weights[slot]
            squares[slot] += slope * slope
            weights[slot] -= 0.5 * slope / math.sqrt(squares[slot])
    return weights


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``base`` and ``added`` spans as arrays of (kind, start, end), ordered by kind and start."""
    found = saved(candidates(docs, id_column, text_column), "candidates")
    spans = found.select(F.explode(F.concat("base", "others")).alias("x"))
    seen = spans.groupBy(*[F.col(f"x.{v}").alias(v) for v in _VOTES]).count()
    counts = {tuple(r)[:5]: r["count"] for r in seen.collect()}  # bounded by the number of patterns
    posterior, _ = fit_labelers(counts)
    weights = train_classifier(spans, posterior)
    sure = math.log(SURE / (1 - SURE))
    order = f"array_position(array{KINDS!r}, x.kind)"
    ordered = "transform(array_sort(transform({spans}, x -> struct(" + order + " AS k, x.start AS start, x.end AS end, x.kind AS kind))), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))"
    added = f"filter(others, x -> {_odds(weights, 'x')} >= {sure!r} AND {_truth(posterior, 'x')} >= 0.5 AND NOT exists(base, y -> y.start < x.end AND x.start < y.end))"
    return found.select(
        F.col("doc_id").alias(id_column),
        F.expr(ordered.format(spans="base")).alias("base"),
        F.expr(ordered.format(spans=added)).alias("added"),
        F.expr(ordered.format(spans=f"concat(base, {added})")).alias("spans"),
    )


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the base counts, the base spans' checksum, all spans as text, and how many spans of each kind were added."""
    found = find_spans(docs, id_column, text_column)
    joined = "array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        id_column,
        *counts,
        F.sha2(F.expr(joined.format(spans="base")), 256).alias("base_sha256"),
        F.expr(joined.format(spans="spans")).alias("spans"),
        *[F.expr(f"CAST(size(filter(added, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_added_{k}") for k in KINDS],
    )
