r"""Personal data by weak supervision; DataFrame and SQL functions only.

Patterns propose spans. Labelers (format rules, gazetteers, context words, shape) vote +1, 0 or -1 on each. A latent
class model fitted by expectation-maximisation estimates how reliable each labeler is, and its posteriors train the
final span classifier, a logistic model over kind and votes. Base kinds (email, ip, card, phone) follow fixed rules and
stay whatever the classifier says; it decides on the further kinds.

Both models see votes only, so they are fitted on the counts of vote patterns: at most kinds * 3^labelers rows, summed
over all documents.

The patterns are possessive and start only where a run starts, which gives the leftmost non-overlapping matches of the
plain patterns in the docstrings below, in linear time on long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked_email", "local_phone", "national_id", "secret", "person")
LABELERS = ("format", "gazetteer", "context", "shape")
#: Least probability of an added span, characters of context before a span, and EM rounds.
LEAST, CONTEXT, ROUNDS = 0.9, 40, 40
#: Matches whose lengths are summed one by one for the position of a match.
STEP = 64

_TITLES = "Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sra|Señor|Señora"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++ ?[\[(]dot[\])] ?[A-Za-z]{2,}+",
    "local_phone": r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{16,}+",
    "person": rf"(?<![\p{{L}}])(?:{_TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?+",
}

#: What a text must hold for a pattern to match at all, tested before it.
GUARDS = {
    "email": "contains(text, '@')",
    "ip": "digits",
    "card": "digits",
    "phone": "contains(text, '+')",
    "masked_email": "contains(text, '(') OR contains(text, '[')",
    "local_phone": "digits",
    "national_id": "digits",
    "secret": "contains(text, '=') OR contains(text, ':')",
    "person": "true",
}

# Gazetteers and context words: fixed values.
TLDS = "com org net edu gov info biz io dev app de fr es it nl be ch at uk us eu ca au jp cn in br mx pl se no dk fi pt".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 971 972".split()
GIVEN_NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan thomas sarah anna peter hans karl julia maria jose carmen juan lucia pierre marie jean sophie claude paul laura emma lukas leon".split()
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|server|host|address|adresse|client|from",
    "card": "card|visa|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"tel|phone|call|mobile|fax|anruf|appel|llam",
    "masked_email": "mail|contact|write|reach|kontakt",
    "local_phone": r"tel|phone|call|mobile|fax|cell|text me",
    "national_id": r"\bssn\b|social security|national id|tax id",
    "secret": r"key|secret|token|auth|credential|login",
    "person": r"name|contact|from|by|dear|sincerely|signed",
}
ANTICUES = r"version|isbn|order|invoice|item|part no|serial|example|section|total|ratio|figure|table"


def _spans(kind: str) -> str:
    """SQL array of (kind, start, end, value, context) of one pattern's matches in `text`, in one pass over them."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    k = KINDS.index(kind)
    empty = "cast(array() AS array<struct<kind:int,start:bigint,end:bigint,value:string,context:string>>)"
    # Lengths l of a piece and its match, and their sums o before each run of STEP: every position is one of these plus
    # less than STEP lengths, so that the time grows with the matches, not with their square.
    before = "element_at(o, cast(i div {n} AS int) + 1) + aggregate(slice(l, cast(i div {n} AS int) * {n} + 1, {m}), 0L, (s, x) -> s + x)"
    start, end = before.format(n=STEP, m=f"i % {STEP}"), before.format(n=STEP, m=f"i % {STEP} + 1")
    return f"""CASE WHEN ({GUARDS[kind]}) AND regexp_like(text, '{pattern}') THEN
      element_at(transform(array(named_struct('m', regexp_extract_all(text, '{pattern}', 0), 'p', split(text, '{pattern}', -1))), z ->
      element_at(transform(array(transform(sequence(0, size(z.m) - 1), i -> cast(char_length(z.p[i]) + char_length(z.m[i]) AS bigint))), l ->
      element_at(transform(array(aggregate(sequence(0, cast((size(l) - 1) div {STEP} AS int)), array(0L), (s, b) -> array_append(s, element_at(s, -1) + aggregate(slice(l, b * {STEP} + 1, {STEP}), 0L, (t, x) -> t + x)))), o ->
        transform(sequence(0, size(l) - 1), i -> named_struct('kind', {k}, 'start', {start} + char_length(z.p[i]), 'end', {end}, 'value', z.m[i], 'context', lower(right(z.p[i], {CONTEXT}))))
      ), 1)), 1)), 1) ELSE {empty} END"""


_DIGITS = "regexp_replace(c.value, '[^0-9]', '')"
_VALID = {
    "ip": "forall(split(c.value, '[.]'), x -> char_length(ltrim('0', x)) <= 3 AND coalesce(try_cast(right(concat('0', ltrim('0', x)), 4) AS int), 999) <= 255)",
    "card": f"luhn_check({_DIGITS})",
    "phone": f"char_length({_DIGITS}) BETWEEN 10 AND 15",
}


def _among(words: list[str], value: str) -> str:
    return f"{value} IN ({', '.join(repr(w) for w in words)})"


def _votes() -> dict[str, str]:
    """SQL votes of each labeler on a span c."""
    d = _DIGITS
    tld = "lower(regexp_extract(c.value, '[A-Za-z0-9-]+$', 0))"
    code = " OR ".join(_among([x for x in COUNTRY_CODES if len(x) == n], f"left({d}, {n})") for n in (1, 2, 3))
    issuer = f"{d} RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|64|62|35)'"
    number = dict(enumerate(KINDS))

    def by_kind(rules: dict[str, str], other: str = "0") -> str:
        return "CASE c.kind " + " ".join(f"WHEN {k} THEN {rules[n]}" for k, n in number.items() if n in rules) + f" ELSE {other} END"

    def yes(test: str, no: int = -1) -> str:
        return f"if({test}, 1, {no})"

    cues = by_kind({n: yes(f"c.context RLIKE '{CUES[n]}'".replace("\\", "\\\\"), 0) for n in CUES})
    return {
        "format": by_kind(
            {
                "email": yes(f"{tld} RLIKE '^[a-z]{{2,}}$' AND NOT startswith(c.value, '.') AND NOT contains(c.value, '..')"),
                "ip": yes("NOT c.value RLIKE '(?:^|[.])0[0-9]'"),
                "card": yes("NOT (contains(c.value, ' ') AND contains(c.value, '-'))"),
                "phone": yes("char_length(replace(c.value, '(', '')) = char_length(replace(c.value, ')', ''))"),
                "masked_email": "1",
                "local_phone": yes("c.value RLIKE '^[(]?[2-9]'"),
                "national_id": yes("NOT c.value RLIKE '^(?:000|666|9)|-00-|0000$'"),
                "secret": yes("c.value RLIKE '[0-9][^0-9]*[0-9]' AND c.value RLIKE '[A-Za-z]'"),
                "person": yes("c.value RLIKE ' [^ ]+ '", 0),
            }
        ),
        "gazetteer": by_kind(
            {
                "email": yes(_among(TLDS, tld), 0),
                "ip": yes("NOT c.value RLIKE '^(?:0|127|255)[.]'"),
                "card": yes(issuer),
                "phone": yes(code),
                "masked_email": yes(_among(TLDS, tld)),
                "local_phone": yes("NOT c.value RLIKE '^[(]?[0-9]11'", -1),
                "person": yes(f"exists(split(lower(c.value), ' '), x -> {_among(GIVEN_NAMES, 'x')})"),
            }
        ),
        "context": f"if(c.context RLIKE '{ANTICUES}', -1, {cues})",
        "shape": by_kind(
            {
                "card": yes(f"char_length({d}) IN (15, 16)", 0),
                "phone": yes(f"char_length({d}) BETWEEN 10 AND 13", 0),
                "secret": yes("char_length(c.value) >= 32", 0),
                "ip": yes("char_length(c.value) >= 9", 0),
            }
        ),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, spans: array of (kind, start, end, votes...); one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.withColumn("digits", F.col("text").rlike("[0-9]")).select("doc_id", *[F.expr(_spans(k)).alias(k) for k in KINDS])
    for kind, test in _VALID.items():
        found = found.withColumn(kind, F.expr(f"filter({kind}, c -> {test})"))
    votes = ", ".join(f"'{n}', cast({sql} AS int)" for n, sql in _votes().items())
    spans = F.expr(f"transform(concat({', '.join(KINDS)}), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end, {votes}))")
    return found.select("doc_id", spans.alias("spans"))


class SpanModel:
    """P(+1 | class) of each labeler from EM, and the span classifier: logit = bias[kind] + sum weight[labeler][vote]."""

    def __init__(self, reliability, bias: list[float], weight: list[list[float]]):
        self.reliability, self.bias, self.weight = reliability, bias, weight

    def sql(self) -> str:
        """SQL probability that a span c is personal data."""
        terms = [f"element_at(array({', '.join(f'{x!r}D' for x in self.bias)}), c.kind + 1)"]
        terms += [f"element_at(array({', '.join(f'{x!r}D' for x in w)}), c.{n} + 2)" for n, w in zip(LABELERS, self.weight, strict=True)]
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def fit(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> SpanModel:
    """(kind, votes, count) rows -> model. EM over the latent class, then gradient steps on its posteriors.

    A labeler that abstains (0) says nothing; of one that votes, P(+1 | class) is estimated, starting from votes that
    are right more often than wrong and smoothed towards that, so that a labeler without votes, or a table without
    spans, leaves the prior.
    """
    n, kinds = len(LABELERS), len(KINDS)
    start = (0.25, 0.8)  # P(+1 | not personal), P(+1 | personal)
    rel = [list(start) for _ in range(n)]
    prior, post = [0.5] * kinds, [0.5] * len(patterns)
    total = sum(c for *_, c in patterns) or 1
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(patterns):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for (p0, p1), v in zip(rel, votes, strict=True):
                odds += math.log(p1 / p0) if v > 0 else math.log((1 - p1) / (1 - p0)) if v < 0 else 0.0
            post[i] = 1 / (1 + math.exp(min(50.0, max(-50.0, -odds))))
        size = 1 + 1e-2 * total
        sums = [[[p * size, size] for p in start] for _ in range(n)]
        share = [[1.0, 2.0] for _ in range(kinds)]
        for (kind, votes, c), p in zip(patterns, post, strict=True):
            share[kind][0] += c * p
            share[kind][1] += c
            for j, v in enumerate(votes):
                for y, q in ((0, 1 - p), (1, p)):
                    sums[j][y][0] += c * q * (v > 0)
                    sums[j][y][1] += c * q * (v != 0)
        prior = [min(0.95, max(0.05, a / b)) for a, b in share]
        rel = [[a / b for a, b in labeler] for labeler in sums]
    bias, weight = [0.0] * kinds, [[0.0] * 3 for _ in range(n)]
    size = [sum(c for k, _, c in patterns if k == kind) or 1 for kind in range(kinds)]
    for _ in range(400):
        db, dw = [0.01 * b for b in bias], [[0.01 * x for x in row] for row in weight]
        for (kind, votes, c), p in zip(patterns, post, strict=True):
            z = bias[kind] + sum(weight[j][v + 1] for j, v in enumerate(votes))
            g = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * c / size[kind]  # each kind weighs the same
            db[kind] += g
            for j, v in enumerate(votes):
                dw[j][v + 1] += g / kinds * (v != 0)
        bias = [b - 0.5 * g for b, g in zip(bias, db, strict=True)]
        weight = [[x - 0.5 * g for x, g in zip(a, b, strict=True)] for a, b in zip(weight, dw, strict=True)]
    return SpanModel(rel, bias, weight)


def vote_patterns(found: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """Counts of (kind, votes) over all candidates: a table of bounded size, whatever the documents."""
    c = found.select(F.explode("spans").alias("c")).groupBy("c.kind", *[f"c.{n}" for n in LABELERS]).count()
    return sorted((r[0], tuple(r[1 : 1 + len(LABELERS)]), r[-1]) for r in c.collect())


def find_personal_data(docs: DataFrame, least: float = LEAST, work: Workspace | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; a row per row of docs.

    base_sha256 and spans are of kind:start:end joined by commas, ordered by start, then kind; code points, end
    exclusive. Base spans are those of fixed rules: ip parts at most 255, cards of 14 to 19 digits that pass Luhn,
    phones of 10 to 15 digits, a failing match being dropped. spans adds those that the classifier trusts by `least`.

    Defined cases: a null or empty text has no spans; rows that share a doc_id are searched each; a null doc_id is
    kept as null; other columns are ignored; without any candidate the model is its prior and adds nothing.
    """
    work = work or Workspace(docs.sparkSession, "pii")
    found = work.save(candidates(docs), "candidates")
    model = fit(vote_patterns(found))
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    text = f"array_join(transform(array_sort({{}}), c -> concat(element_at({names}, c.kind + 1), ':', c.start, ':', c.end)), ',')"
    base = f"filter(spans, c -> c.kind < {len(BASE)})"
    kept = f"filter(spans, c -> c.kind < {len(BASE)} OR {model.sql()} >= {least!r}D)"
    counts = [F.expr(f"cast(size(filter(spans, c -> c.kind = {k})) AS bigint)").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.expr(text.format(base)), 256).alias("base_sha256"), F.expr(text.format(kept)).alias("spans"), F.expr(f"cast(size({kept}) - size({base}) AS bigint)").alias("n_added"))
