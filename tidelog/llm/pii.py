"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base matches of four kinds (email, ip, card, phone) and looser ones (written-out emails,
national phone numbers, cards of 13 to 15 digits, IPv6). Five labelers vote on each (1 personal, 0 none, 2 not):
the strict pattern, a validator (checksum, range, shape), a gazetteer (top domains, calling codes, issuer
prefixes, reserved addresses), the words before it, and its borders. Expectation-maximisation over
the counts of vote patterns estimates the labelers' reliabilities and the share of each kind; a logistic span classifier, trained on the
posteriors, decides on the candidates that are not base matches. Base matches always stay.

The vote patterns (4 kinds x 3^5 votes x 3 lengths at most, whatever the corpus) are the only thing that reaches the driver;
their counts are over all documents. Work on texts is row by row.

Edge cases: a null text counts as empty; an empty table gives no rows; repeated rows give equal rows;
extra columns are ignored by the query and kept by ``mask``. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive loops and a start that doesn't retry inside a run (equal matches, linear time).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": BASE["card"],
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: Of the looser matches, those that count.
_WIDER = {"email": "true", "ip": "true", "card": "length(regexp_replace(x.m, '[^0-9]', '')) between 13 and 15", "phone": "true"}
#: What a text must hold before a pattern is tried.
HINT = {"email": "contains(text, '@')", "ip": "contains(text, '.')", "card": "true", "phone": "contains(text, '+')"}
LOOSE_HINT = {"email": r"text rlike '(?i)[\\[({]at[\\])}]'", "ip": "contains(text, ':')", "card": "true", "phone": "true"}
CUES = {
    "email": "e-?mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\\bip\\b|host|server|address|addr|login|from",
    "card": "card|visa|master|amex|credit|debit|tarjeta|carte|karte|payment",
    "phone": "phone|call|tel|mobile|cell|fax|whatsapp|handy|ruf|llam|appel",
}
AGAINST = "version|isbn|issn|order|invoice|section|chapter|token|hash|serial|build|part no|doi|pages?"
LABELERS = ("strict", "valid", "gazetteer", "context", "border")
Model = dict[str, float]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


_BLOCK, _CHUNK = 64, 1024


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, value: str, join: str, made: str, kind: str) -> str:
    """The arrays ``made`` of every x of ``items`` end to end, where ``at`` is the ``join`` (of a and v) of the values before x.

    Items are taken in blocks, whose values are joined first, so that no array is copied once an item: linear in the items."""
    empty = f"cast(array() as array<{kind}>)"
    total = f"aggregate(k, 0, (a, x) -> {join.format(a='a', v=value)})"
    bases = f"aggregate(transform(blocks, k -> {total}), array(0), (a, x) -> array_append(a, {join.format(a='element_at(a, -1)', v='x')}))"
    step = f"struct({join.format(a='a.at', v=value)} as at, concat(a.o, {made.format(at='a.at')}) as o)"
    inner = f"flatten(transform(blocks, (k, i) -> aggregate(k, struct(bases[i] as at, {empty} as o), (a, x) -> {step}, a -> a.o)))"
    blocks = f"transform(sequence(0, cast((size(every) - 1) div {_BLOCK} as int)), i -> slice(every, i * {_BLOCK} + 1, {_BLOCK}))"
    return _let(items, "every", f"if(size(every) = 0, {empty}, {_let(blocks, 'blocks', _let(bases, 'bases', inner))})")


def _chunks(text: str = "text") -> str:
    """A text in chunks, so that a part far inside is found without counting from its start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_CHUNK}}}+', 0)"


def _part(a: str, b: str) -> str:
    """Code points [a, b) of the text whose chunks are c."""
    first, last = f"cast(({a}) div {_CHUNK} as int)", f"cast((({b}) - 1) div {_CHUNK} as int)"
    return f"if(({b}) > ({a}), substring(array_join(slice(c, {first} + 1, {last} - {first} + 1), ''), cast(({a}) % {_CHUNK} as int) + 1, ({b}) - ({a})), '')"


def _found(column: str, pattern: str) -> str:
    """SQL for array<struct<m, s, e>> of the matches in ``column`` (an array of strings) within text."""
    cut = f"split(text, {_quoted(pattern)}, -1)"
    step = f"zip_with({column}, transform(slice({cut}, 1, size({column})), p -> length(p)), (m, l) -> struct(m, l))"
    kind = "struct<m: string, s: int, e: int>"
    made = _scan(step, "x.l + length(x.m)", "{a} + {v}", "array(struct(x.m as m, {at} + x.l as s, {at} + x.l + length(x.m) as e))", kind)
    return f"if(size({column}) = 0, cast(array() as array<{kind}>), {made})"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"pmod(aggregate(transform(filter(split(reverse({_DIGITS}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0))), 0, (a, v) -> a + v), 10) = 0"
_SMALL = "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
_PASSES = {"email": "true", "ip": _SMALL, "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}", "phone": f"length({_DIGITS}) between 8 and 15"}
_VALID = {
    "email": "if(x.m rlike '[.] ?[A-Za-z]{2,24}$|dot[)}\\\\]] ?[A-Za-z]{2,24}$', 1, 2)",
    "ip": f"if(contains(x.m, ':') or ({_SMALL}), 1, 2)",
    "card": f"if({_LUHN} and not {_DIGITS} rlike '^([0-9])\\\\1*$', 1, 2)",
    "phone": f"if(length({_DIGITS}) between 8 and 15 and not {_DIGITS} rlike '^([0-9])\\\\1*$', 1, 2)",
}
_GAZETTEER = {
    "email": "if(lower(x.m) rlike '[.)}\\\\]] ?(com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co|us|ca|ch|at|be|it|nl|pt|br|mx|ar)$', 1, 0)",
    "ip": "if(x.m rlike '^(0|127|22[4-9]|2[3-5][0-9])[.]', 2, if(contains(x.m, ':'), 0, 1))",
    "card": f"if({_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6(011|5)|35|30|36)', 1, 2)",
    "phone": "if(x.m rlike '^[+](1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])', 1, if(startswith(x.m, '+'), 2, 0))",
}


def _votes(kind: str, base: bool) -> str:
    before = f"lower({_part('greatest(x.s - 32, 0)', 'x.s')})"
    context = f"if({before} rlike '({CUES[kind]})[^a-z]*([a-z]+[^a-z]+)?$', 1, if({before} rlike '({AGAINST})[^a-z]*$', 2, 0))"
    border = f"if({_part('greatest(x.s - 1, 0)', 'x.s')} rlike '[\\\\p{{L}}\\\\p{{N}}_]' or {_part('x.e', 'x.e + 1')} rlike '[\\\\p{{L}}\\\\p{{N}}_]', 2, 1)"
    size = "if(length(x.m) < 12, 0, if(length(x.m) < 24, 1, 2))"
    return f"struct('{kind}' as kind, x.s as s, x.e as e, {base} as base, {int(base)} as strict, {_VALID[kind]} as valid, {_GAZETTEER[kind]} as gazetteer, {context} as context, {border} as border, {size} as size)".replace(f"{base} as base", f"{str(base).lower()} as base")


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``spans``: every candidate with its votes, base matches first. Time is linear in a text and its matches."""
    x = docs.select(*(c for c in keep if c != "text"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.select("*", *(F.expr(f"if({HINT[k]}, regexp_extract_all(text, {_quoted(BASE[k])}, 0), array())").alias(f"_m_{k}") for k in KINDS), *(F.expr(f"if({LOOSE_HINT[k]}, regexp_extract_all(text, {_quoted(LOOSE[k])}, 0), array())").alias(f"_l_{k}") for k in KINDS))
    x = x.select(*keep, *(["text"] if "text" not in keep else []), *(F.expr(f"filter({_found(f'_m_{k}', BASE[k])}, x -> {_PASSES[k]})").alias(f"_b_{k}") for k in KINDS), *(F.expr(f"filter({_found(f'_l_{k}', LOOSE[k])}, x -> {_WIDER[k]})").alias(f"_w_{k}") for k in KINDS))
    # A looser match goes if it meets a base match: in the order of base starts and loose ends, if a base match before ends after its start.
    events = [f"transform(_b_{k}, x -> struct(x.s as p, 1 as base, x.s as s, x.e as e, '{k}' as kind, '' as m))" for k in KINDS] + [f"transform(_w_{k}, x -> struct(x.e as p, 0 as base, x.s as s, x.e as e, '{k}' as kind, x.m as m))" for k in KINDS]
    loose = "struct<m: string, s: int, e: int, kind: string>"
    free = _scan(f"array_sort(concat({', '.join(events)}))", "if(x.base = 1, x.e, 0)", "greatest({a}, {v})", f"if(x.base = 0 and {{at}} <= x.s, array(struct(x.m as m, x.s as s, x.e as e, x.kind as kind)), cast(array() as array<{loose}>))", loose)
    none = " and ".join(f"size(_w_{k}) = 0" for k in KINDS)
    x = x.withColumn("_free", F.expr(f"if({none}, cast(array() as array<{loose}>), {free})"))
    base = [f"transform(_b_{k}, x -> {_votes(k, True)})" for k in KINDS]
    more = [f"transform(filter(_free, x -> x.kind = '{k}'), x -> {_votes(k, False)})" for k in KINDS]
    some = " + ".join(f"size(_b_{k})" for k in KINDS) + " + size(_free) > 0"
    return x.select(*keep, F.expr(_let(f"if({some}, {_chunks()}, array())", "c", "concat(" + ", ".join(base + more) + ")")).alias("spans"))


def estimate(patterns: list[tuple], rounds: int = 200) -> np.ndarray:
    """Posteriors of (kind, votes.., size, n) patterns by expectation-maximisation: labelers are independent given the truth."""
    votes = np.array([p[1:6] for p in patterns])
    n = np.array([p[-1] for p in patterns], float)
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    good = (votes == 1).sum(axis=1) - (votes == 2).sum(axis=1)
    post = 1 / (1 + np.exp(-(good - 1.5)))
    for _ in range(rounds):
        share = np.array([(np.sum((post * n)[kinds == k]) + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(share / (1 - share))[kinds]
        for j in range(votes.shape[1]):
            yes = np.array([np.sum((post * n)[votes[:, j] == v]) + (2.0, 4.0, 1.0)[v] for v in range(3)])
            no = np.array([np.sum(((1 - post) * n)[votes[:, j] == v]) + (2.0, 1.0, 4.0)[v] for v in range(3)])
            odds = odds + np.log(yes / yes.sum() / (no / no.sum()))[votes[:, j]]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def fit(spans: DataFrame) -> Model:
    """Weights of the span classifier from the ``spans`` of all documents."""
    counts = spans.select(F.explode("spans").alias("x")).groupBy("x.kind", *(f"x.{v}" for v in LABELERS), "x.size").agg(F.count("*").alias("n")).collect()  # bounded: vote patterns
    patterns = sorted(tuple(r) for r in counts)
    if not patterns:
        return {"bias": 0.0}
    post = estimate(patterns)
    names = [f"{v}{k}" for v in LABELERS for k in (1, 2)] + ["size1", "size2"] + list(KINDS[1:])
    x = np.array([[float(p[1 + j] == k) for j in range(5) for k in (1, 2)] + [float(p[6] == 1), float(p[6] == 2)] + [float(p[0] == k) for k in KINDS[1:]] for p in patterns])
    z, n = np.c_[x, np.ones(len(x))], np.array([p[-1] for p in patterns], float)
    n = n / n.sum() * 1000 + 0.1  # rare patterns count too
    beta, ridge = np.zeros(z.shape[1]), np.diag([0.5] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge, z.T @ (n * (post - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {k: round(float(b), 9) for k, b in zip([*names, "bias"], beta, strict=True)}


def _logit(model: Model) -> str:
    terms = [repr(model["bias"])]
    for name, w in model.items():
        if name in KINDS:
            terms.append(f"if(x.kind = '{name}', {w!r}, 0.0)")
        elif name != "bias":
            terms.append(f"if(x.{name[:-1]} = {name[-1]}, {w!r}, 0.0)")
    return " + ".join(f"double({t})" for t in terms)


def decided(spans: DataFrame, model: Model) -> DataFrame:
    """``spans`` reduced to base matches and the candidates that the classifier takes."""
    return spans.withColumn("spans", F.expr(f"filter(spans, x -> x.base or ({_logit(model)}) >= 0)"))


def _listed(which: str) -> str:
    order = "(l, r) -> case when l.k <> r.k then l.k - r.k else l.s - r.s end"
    rows = f"transform(filter(spans, x -> {which}), x -> struct(array_position(array('email', 'ip', 'card', 'phone'), x.kind) as k, x.kind as kind, x.s as s, x.e as e))"
    return f"array_join(transform(array_sort({rows}, {order.replace('l.k - r.k', 'cast(l.k - r.k as int)')}), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def op4_weak_supervision(docs: DataFrame) -> DataFrame:
    found = written(candidates(docs, ["doc_id"]), "spans")
    final = decided(found, fit(found))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return final.select("doc_id", *counts, F.sha2(F.expr(_listed("x.base")), 256).alias("base_sha256"), F.expr(_listed("true")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every personal span of ``text`` replaced by its kind in brackets (of spans that meet, the first one's); null texts stay null."""
    names = docs.columns
    inner = ["text" if c == "text" else f"_in_{k}" for k, c in enumerate(names)]  # clear of the columns that are made here
    kept = written(candidates(docs.toDF(*inner).withColumn("_null", F.col("text").isNull()), [*inner, "_null"]), "spans")  # texts are searched once
    rows = decided(kept, fit(kept))
    order = "array_sort(transform(spans, x -> struct(x.s as s, x.e as e, x.kind as kind)))"
    made = "if(x.s >= {at}, array(concat(" + _part("{at}", "x.s") + ", '[', upper(x.kind), ']')), cast(array() as array<string>))"
    pieces = _scan(order, "x.e", "greatest({a}, {v})", made, "string")
    rest = _part("array_max(transform(spans, x -> x.e))", "length(text)")
    masked = _let(_chunks(), "c", f"concat(array_join({pieces}, ''), {rest})")
    return rows.withColumn("text", F.expr(f"case when _null then null when size(spans) = 0 then text else {masked} end")).select(*inner).toDF(*names)
