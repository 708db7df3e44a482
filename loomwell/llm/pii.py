"""Personal data by weak supervision, in DataFrame expressions only.

Four kinds have exact definitions (e-mail, IP address, payment card, phone) and
are found by pattern and check. Beyond them, runs of 16 and more letters and
digits, with the signs _ - . / + between them, are candidates for secrets (keys,
tokens, passwords). Labelers by pattern, gazetteer and context, each looking at
something else, vote on each candidate or abstain; how often each combination of
votes and features occurs is counted over all candidates. Expectation-maximisation
on that table estimates the labelers' reliabilities, and its posteriors train a
logistic span classifier on the features, whose weights go back into an
expression. The table's rows are bounded by the number of combinations, whatever
the corpus. What a corpus never shows (a known prefix, say) keeps the weight that
a few made-up candidates give it.

Names of persons and postal addresses are no kinds of this operator.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import own_prefix
from loomwell.llm.tokens import vocabulary

KINDS = ("email", "ip", "card", "phone", "secret")

#: The definitions, with possessive quantifiers and starts at the beginning of a run, so that no text makes them
#: backtrack; they find what the plain patterns find, leftmost and non-overlapping.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![\p{L}\p{N}@_./+-])(?=[A-Za-z0-9][A-Za-z0-9_./+-]{15})[A-Za-z0-9]++(?:[_./+-]++[A-Za-z0-9]++)*+={0,2}+(?![\p{L}\p{N}@])",
}

#: How keys and tokens of public services begin.
PREFIXES = (
    "AIza", "AKIA", "ASIA", "ATATT", "EAAC", "SG.", "ddp_", "dckr_pat_", "doo_v1_", "dop_v1_", "dor_v1_", "eyJ", "figd_", "ghp_", "gho_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "glptt-", "glsa_",
    "hf_", "hvb.", "hvs.", "lin_api_", "npm_", "pk_live_", "pk_test_", "pscale_", "pypi-", "rk_live_", "rk_test_", "shpat_", "shpca_", "shppa_", "shpss_", "sk-", "sk_live_", "sk_test_", "sq0atp-", "sq0csp-",
    "tfp_", "whsec_", "xapp-", "xoxa-", "xoxb-", "xoxe-", "xoxp-", "xoxr-", "xoxs-", "ya29.",
)

#: Words before a secret, and what comes before addresses and paths.
CONTEXT = r"(?i)(?:password|passwd|pwd|token|secret|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|auth|bearer|credential)s?[\x20\x22\x27=:]{1,4}$"
PLACE = "(?:://|www[.]|/)$"

#: Words of the gazetteer: the commonest of the vocabulary file, by their place in it.
WORDS = 3_000

MARK, STAND_IN = "\x01", "\x03"


def _check(kind: str, s: str) -> str:
    """SQL: whether the match ``s`` (SQL too) is one of the kind."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return rf"{s} rlike r'^{part}(?:\.{part}){{3}}$'"
    if kind == "card":
        add = "t + CASE WHEN i % 2 = 1 THEN int(substr(d, i, 1)) ELSE 2 * int(substr(d, i, 1)) - IF(int(substr(d, i, 1)) > 4, 9, 0) END"
        return f"exists(array(reverse(regexp_replace({s}, '[ -]', ''))), d -> length(d) BETWEEN 16 AND 19 AND aggregate(sequence(1, length(d)), 0, (t, i) -> {add}) % 10 = 0)"
    if kind == "phone":
        return f"length(regexp_replace({s}, '[^0-9]', '')) BETWEEN 8 AND 15"
    return f"length({s}) >= 16" if kind == "secret" else "true"


def _worth(kind: str, t: Column) -> Column:
    """A cheap sign that the text may hold the kind."""
    return {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]{2}|[0-9][\\x20-][0-9]"), "secret": F.lit(True)}[kind]


_SPAN = "struct<kind:int,start:bigint,end:bigint,s:string,before:string>"


def _folded(n: str, start: str, step: Callable[[str, str], str], item: str, last: str) -> str:
    """SQL: fold ``step`` over 0 .. n - 1, which makes of (at, i) structs of at, a
    long, and out, an array<``item``> of what this one number adds; ``last`` is
    made of z, with at and out, the adds joined. Arrays grow in runs of about
    sqrt(n), so a text with very many spans isn't copied for each."""
    width = f"greatest(16, int(ceil(sqrt({n}))))"
    run = f"sequence(k * {width}, least((k + 1) * {width}, {n}) - 1)"
    inner = f"aggregate({run}, named_struct('at', o.at, 'out', cast(array() AS array<{item}>)), (a, i) -> transform(array({step('a.at', 'i')}), v -> named_struct('at', v.at, 'out', concat(a.out, v.out)))[0])"
    outer = f"transform(array({inner}), w -> named_struct('at', w.at, 'out', concat(o.out, array(w.out))))[0]"
    zero = f"named_struct('at', {start}, 'out', cast(array() AS array<array<{item}>>))"
    return f"aggregate(sequence(0, int(floor(({n} - 1) / {width}))), {zero}, (o, k) -> {outer}, y -> transform(array(named_struct('at', y.at, 'out', flatten(y.out))), z -> {last})[0])"


def _spans(kind: str, pieces: str) -> Column:
    """Spans of the column ``pieces``, which are the texts between and, at odd
    places, of the matches: array of (kind, start, end, s, before)."""
    empty, n = f"cast(array() AS array<{_SPAN}>)", f"int(floor((size({pieces}) - 1) / 2))"

    def step(at: str, i: str) -> str:
        gap, s = f"get({pieces}, 2 * {i})", f"get({pieces}, 2 * {i} + 1)"
        start = f"{at} + length({gap})"
        before = f"right({gap}, 24)" if kind == "secret" else "cast(null AS string)"
        return f"named_struct('at', {start} + length({s}), 'out', array(named_struct('kind', {KINDS.index(kind)}, 'start', {start}, 'end', {start} + length({s}), 's', {s}, 'before', {before})))"

    all_of = _folded(n, "0L", step, _SPAN, "z.out")
    return F.expr(f"CASE WHEN coalesce({n}, 0) > 0 THEN filter({all_of}, x -> {_check(kind, 'x.s')}) ELSE {empty} END")


def _found(docs: DataFrame, p: str, kinds: tuple[str, ...]) -> DataFrame:
    """``docs`` with, for each kind, its spans in a column named ``p`` + kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # the mark is in no pattern, so another control character may stand for one in the text
    df = docs.withColumn(f"{p}t", F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text))
    t = F.col(f"{p}t")
    df = df.withColumns({f"{p}{k}_pieces": F.when(_worth(k, t), F.split(F.regexp_replace(t, PATTERNS[k], f"{MARK}$0{MARK}"), MARK)) for k in kinds})
    df = df.withColumns({f"{p}{k}": _spans(k, f"`{p}{k}_pieces`") for k in kinds})
    return df.drop(f"{p}t", *[f"{p}{k}_pieces" for k in kinds])


@functools.cache
def gazetteer(path: str, most: int = WORDS) -> tuple[str, ...]:
    """The first ``most`` whole words of four letters and more in a public vocabulary file."""
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    whole = [w.removesuffix("</w>") for w in sorted(words, key=words.get) if w.endswith("</w>")] or [w.lstrip("Ġ▁") for w in sorted(words, key=words.get)]
    return tuple(dict.fromkeys(w for w in whole if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower()))[:most]


_PREFIX = "^(?:" + "|".join(p.replace(".", "[.]") for p in PREFIXES) + ")"
_SOUNDLESS = "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z0-9]{6}"


def _wordy(s: str) -> str:
    """SQL: whether all parts between signs look like words, names with a number, or numbers."""
    return f"forall(split({s}, '[_./+=-]+'), part -> part rlike '^(?:(?:[A-Z]?[a-z]*|[A-Z]+)[0-9]{{0,2}}|[0-9]{{1,4}})$')"


def _known_words(s: str, words: tuple[str, ...]) -> str:
    """SQL: how many letters of ``s`` stand in words of the gazetteer, which is one literal."""
    return f"length(array_join(filter(split(lower({s}), '[^a-z]+'), part -> contains(' {' '.join(words)} ', concat(' ', part, ' '))), ''))"


def _digits(s: str) -> str:
    return f"(length(regexp_replace({s}, '[^0-9]', '')) / length({s}))"


def votes(x: str, words: tuple[str, ...]) -> str:
    """SQL: array of votes on the candidate ``x``: 1 secret, -1 not, 0 none. By form,
    by the gazetteer of prefixes, by the gazetteer of words, by context, by digits
    and by sound (six signs and more without a vowel)."""
    s, before = f"{x}.s", f"{x}.before"
    cast = [
        (f"{s} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' AND {s} rlike '[0-9]' AND {s} rlike '[A-Fa-f]'", _wordy(s)),
        (f"{s} rlike '{_PREFIX}'", "false"),
        ("false", f"2 * {_known_words(s, words)} > length({s})"),
        (f"{before} rlike r'{CONTEXT}'", f"{before} rlike '{PLACE}'"),
        (f"{_digits(s)} BETWEEN 0.1 AND 0.9", f"{_digits(s)} = 0"),
        (f"{s} rlike '{_SOUNDLESS}'", f"{s} rlike '^[A-Za-z_./+-]+$'"),
    ]
    return "array(" + ", ".join(f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END" for yes, no in cast) + ")"


#: What the span classifier sees, each between 0 and 1 in a few steps.
FEATURES = ("long", "digits", "turns", "cases", "hexadecimal", "wordy", "context", "place", "prefix", "words", "sound")


def features(x: str, words: tuple[str, ...]) -> str:
    """SQL: array of FEATURES of the candidate ``x``."""
    s, before, share = f"{x}.s", f"{x}.before", _digits(f"{x}.s")
    turns = f"regexp_count({s}, '[0-9][A-Za-z]|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])')"
    flags = [f"{s} rlike '[A-Z].*[A-Z]'", f"{s} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$'", _wordy(s), f"{before} rlike r'{CONTEXT}'", f"{before} rlike '{PLACE}'", f"{s} rlike '{_PREFIX}'", f"2 * {_known_words(s, words)} > length({s})", f"{s} rlike '{_SOUNDLESS}'"]
    steps = [
        f"CASE WHEN length({s}) < 20 THEN 0D WHEN length({s}) < 32 THEN 0.5D ELSE 1D END",
        f"CASE WHEN {share} = 0 THEN 0D WHEN {share} < 0.5 THEN 0.5D WHEN {share} < 1 THEN 0.75D ELSE 1D END",
        f"CASE WHEN {turns} = 0 THEN 0D WHEN {turns} < 3 THEN 0.5D ELSE 1D END",
    ]
    return "array(" + ", ".join([*steps, *[f"IF({f}, 1D, 0D)" for f in flags]]) + ")"


#: Made-up candidates, (features that are not 0, whether it is a secret): a dozen of each keep the classifier sane where a corpus shows none.
MADE_UP = (
    ({"long": 1, "digits": 0.5, "turns": 1, "cases": 1, "prefix": 1, "sound": 1}, 1), ({"long": 0.5, "digits": 0.5, "turns": 1, "prefix": 1, "sound": 1}, 1), ({"digits": 0.5, "turns": 0.5, "prefix": 1, "cases": 1}, 1),
    ({"long": 1, "digits": 0.5, "turns": 1, "cases": 1, "sound": 1, "prefix": 1, "context": 1}, 1), ({"long": 1, "digits": 0.5, "turns": 1, "hexadecimal": 1, "context": 1, "sound": 1}, 1),
    ({"long": 1, "digits": 0.5, "turns": 1, "cases": 1, "context": 1, "sound": 1}, 1), ({"digits": 0.5, "turns": 1, "cases": 1, "context": 1}, 1), ({"long": 1, "digits": 0.5, "turns": 1, "cases": 1, "sound": 1}, 1),
    ({"wordy": 1}, 0), ({"wordy": 1, "words": 1}, 0), ({"wordy": 1, "long": 1, "place": 1}, 0), ({"wordy": 1, "words": 1, "long": 0.5, "sound": 1}, 0), ({"digits": 1, "sound": 1}, 0), ({"digits": 0.5, "turns": 0.5, "wordy": 1, "place": 1}, 0),
    ({"long": 1, "digits": 0.5, "turns": 1, "place": 1, "words": 1}, 0), ({"long": 0.5, "digits": 0.75, "turns": 0.5}, 0), ({"wordy": 1, "cases": 1}, 0), ({"wordy": 1, "context": 1}, 0),
)


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over (votes, number): the posterior of each row,
    the share of secrets and the chances (class, labeler, vote) of -1, 0 and 1.
    A labeler may not vote 1 oftener on the other class than on secrets."""
    v = np.array([x for x, _ in table], np.int64) + 1
    n = np.array([c for _, c in table], float)
    cast, r = (v[:, :, None] == np.arange(3)).astype(float), np.arange(v.shape[1])
    start = np.repeat(np.array([[0.6, 0.38, 0.02], [0.05, 0.45, 0.5]])[:, None, :], v.shape[1], axis=1)
    chance, prior, p = start.copy(), 0.2, np.zeros(len(table))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + np.log(chance[1, r, v] / chance[0, r, v]).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        w = np.stack([n * (1 - p), n * p])
        chance = (np.einsum("cn,nrv->crv", w, cast) + 10 * start) / (w.sum(1)[:, None, None] + 10)
        wrong = chance[0, :, 2] > chance[1, :, 2]
        chance[:, wrong] = chance[:, wrong].mean(0)
        prior = float(np.clip((w[1].sum() + 2) / (n.sum() + 10), 0.001, 0.999))
    return p, prior, chance


def train(docs: DataFrame, rounds: int = 100, words: tuple[str, ...] | None = None) -> list[float]:
    """Bias and weights (of FEATURES) of the span classifier, from all candidates
    of ``docs`` and a dozen of each made-up one. Posteriors are soft labels; the
    loss is summed, not averaged, so what a corpus shows outweighs what is made up."""
    words = gazetteer(vocabulary()) if words is None else words
    # explode() would filter by size first, and evaluate the patterns again for every piece there
    found = _found(docs.select("text"), "own_", ("secret",)).select(F.explode_outer("own_secret").alias("span")).filter("span is not null")
    counted = found.groupBy(F.expr(votes("span", words)).alias("v"), F.expr(features("span", words)).alias("x")).count().collect()  # bounded by the combinations
    counted = sorted(counted, key=lambda r: (r["v"], r["x"]))
    p = reliabilities([(tuple(r["v"]), r["count"]) for r in counted])[0].tolist() if counted else []
    x = np.array([[1.0, *r["x"]] for r in counted] + [[1.0, *[float(f.get(k, 0)) for k in FEATURES]] for f, _ in MADE_UP])
    p = np.array(p + [0.98 if y else 0.02 for _, y in MADE_UP])
    n = np.array([float(r["count"]) for r in counted] + [12.0] * len(MADE_UP))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps on the expected log loss, with a ridge, halved where they overshoot
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - q)) - w)
        loss = _loss(x, n, p, w)
        while _loss(x, n, p, w + step) > loss + 1e-9 and np.abs(step).max() > 1e-10:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w.tolist()


def _loss(x: np.ndarray, n: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    z = x @ w
    return float((n * (np.logaddexp(0, z) - p * z)).sum() + w @ w / 2)


def is_secret(x: str, weights: list[float], words: tuple[str, ...]) -> str:
    """SQL: the classifier's verdict on the candidate ``x``."""
    score = " + ".join([f"{weights[0]!r}D", *[f"{w!r}D * f[{i}]" for i, w in enumerate(weights[1:])]])
    return f"exists(array({features(x, words)}), f -> {score} > 0)"


#: Weights that take no candidate for a secret.
NEVER = [-9.0] + [0.0] * len(FEATURES)


def find(docs: DataFrame, p: str = "", weights: list[float] | None = None, words: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with ``p`` + spans: array of (kind, start, end), kinds numbered as
    in KINDS, by kind and then start; base kinds always stay. Rows of ``weights``
    beyond FEATURES are not read.

    Null and empty texts have none; an empty table gives no rows; very long texts
    are handled whole; repeated rows alike; columns of ``docs`` pass through, and
    one of the name ``p`` + spans is replaced; no shuffle.
    """
    words = gazetteer(vocabulary()) if words is None else words
    weights = train(docs, words=words) if weights is None else weights[: len(FEATURES) + 1]
    q = own_prefix(docs)
    df = _found(docs, q, KINDS)
    found = ", ".join([f"`{q}{k}`" for k in KINDS[:-1]] + [f"filter(`{q}secret`, x -> {is_secret('x', weights, words)})"])
    spans = F.expr(f"transform(concat({found}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    return df.withColumn(f"{p}spans", spans).drop(*[q + k for k in KINDS])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets;
    of overlapping spans the first, or the longer of two that begin together,
    names the whole. ``n_chars``, where there is one, counts the new text. Null
    texts stay null, empty ones empty; an empty table gives no rows; other
    columns pass through whatever their names. A text is cut in runs of spans
    first, so very long ones with very many spans aren't walked for each."""
    q = own_prefix(docs)
    df = find(docs, q, weights)
    df = df.withColumn(f"{q}by", F.expr(f"array_sort(transform(`{q}spans`, x -> named_struct('start', x.start, 'far', -x.end, 'kind', x.kind)))"))
    by, n, text = f"`{q}by`", F.size(f"{q}by"), F.col("text")
    names, size = ", ".join(f"'<{k.upper()}>'" for k in KINDS), f"size({by})"
    width = f"greatest(16, int(ceil(sqrt({size}))))"
    # a run of spans cuts the text up to its last span's start out once, and then works on that
    mine = f"slice({by}, k * {width} + 1, {width})"
    block = f"substring(text, int(o.at + 1), int(greatest(element_at({mine}, -1).start - o.at, 0)))"
    gap = "substring(b, int(a.at - o.at + 1), int(x.start - a.at))"
    step = f"named_struct('at', greatest(a.at, -x.far), 'out', IF(x.start >= a.at, concat(a.out, array({gap}, element_at(array({names}), x.kind + 1))), a.out))"
    run = f"transform(array({block}), b -> aggregate({mine}, named_struct('at', o.at, 'out', cast(array() AS array<string>)), (a, x) -> {step}))"
    outer = f"transform({run}, w -> named_struct('at', w.at, 'out', concat(o.out, array(w.out))))[0]"
    rest = "substring(text, int(y.at + 1), length(text))"
    new = F.expr(f"aggregate(sequence(0, int(floor(({size} - 1) / {width}))), named_struct('at', 0L, 'out', cast(array() AS array<array<string>>)), (o, k) -> {outer}, y -> concat(array_join(flatten(y.out), ''), {rest}))")
    df = df.withColumn("text", F.when(n > 0, new).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(n > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
