"""Quality rules by weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or
abstains (0). How often each pattern of votes occurs is counted over all
documents; expectation-maximisation on that table estimates each rule's
accuracy and the share of good documents, and the posterior probability of
quality replaces the demand that all rules pass: a bad vote that no other rule
bears out is outweighed by the good ones. The table has at most 3**rules rows
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm.common import IS_SPACE, own_prefix, stored, utf8_slices

#: Counts of a document, all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_marks")

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of some whole UTF-8 texts.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_dup_lines (lines with a word that equal an earlier one), n_repeat_words
    (words in a 3-word window that occurs twice or more in the text), n_lines
    (with a word), n_upper and n_letters (A-Z, and letters), n_distinct words,
    n_marks (``!?``).
    """
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum(size)])

    def per_text(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[ends[1:]] - total[ends[:-1]]

    def among(*values: int) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(values)] = True
        return t

    inside = ~IS_SPACE
    inside[0x80:0xC0] = False
    letters = among(*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))
    out = {"word_chars": per_text(inside), "n_symbols": per_text(among(*SYMBOLS)), "n_marks": per_text(among(*MARKS)), "n_upper": per_text(among(*range(0x41, 0x5B))), "n_letters": per_text(letters)}
    words = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    n_words = np.fromiter(map(len, words), np.int64, n)
    doc = np.repeat(np.arange(n), n_words)
    out["n_words"] = n_words
    if len(which):
        pair = np.unique(doc * len(number) + which)
        out["n_distinct"] = np.bincount(pair // len(number), minlength=n)
    else:
        out["n_distinct"] = np.zeros(n, np.int64)
    out["n_repeat_words"] = _in_repeats(which, doc, n)
    lines = np.zeros(n, np.int64)
    again = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if n_words[i]:
            full = [x for x in t.split(b"\n") if x and not x.isspace()]
            lines[i], again[i] = len(full), len(full) - len(set(full))
    out |= {"n_lines": lines, "n_dup_lines": again}
    return out


def _in_repeats(which: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, words in 3-word windows that the text holds twice or more."""
    if len(which) < 3:
        return np.zeros(n, np.int64)
    # windows as numbers: pairs first, then pairs with a third word and the text; exact, as each step is renumbered
    base = int(which.max()) + 1
    pair = np.unique(which[:-1] * base + which[1:], return_inverse=True)[1]
    ok = np.flatnonzero(doc[:-2] == doc[2:])
    third = np.unique(pair[ok] * base + which[ok + 2], return_inverse=True)[1]
    # text by text the windows that occur again
    key = doc[ok] * (int(third.max(initial=-1)) + 1) + third
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(which), bool)
    for k in range(3):
        covered[ok[twice] + k] = True
    return np.bincount(doc[covered], minlength=n)


@dataclass(frozen=True)
class Rule:
    """A ratio of counts: up to ``good`` (or from it on, if that is larger) is a
    vote for good, beyond ``bad`` for bad, between them none. ``aspect`` is the
    kind of bad text that it is made for, together with others."""

    name: str
    over: Column
    good: float
    bad: float
    aspect: str

    def vote(self) -> Column:
        yes, no = (self.over <= self.good, self.over > self.bad) if self.good < self.bad else (self.over >= self.good, self.over < self.bad)
        return F.coalesce(F.when(yes, 1).when(no, -1), F.lit(0))


def rules(p: str = "") -> list[Rule]:
    """The rules over COUNTS whose columns' names begin with ``p``."""

    def share(a: str, b: str, power: float = 1.0) -> Column:
        return F.try_divide(F.col(p + a).cast("double"), F.pow(F.col(p + b).cast("double"), F.lit(power)))

    return [
        Rule("repeats", share("n_repeat_words", "n_words"), 0.1, 0.3, "repetition"),
        Rule("variety", share("n_distinct", "n_words", 0.7), 2.5, 1.5, "repetition"),
        Rule("distinct", share("n_distinct", "n_words"), 0.6, 0.45, "repetition"),
        Rule("dup_lines", share("n_dup_lines", "n_lines"), 0.1, 0.3, "repetition"),
        Rule("symbols", share("n_symbols", "n_words"), 0.02, 0.12, "signs"),
        Rule("letters", share("n_letters", "word_chars"), 0.93, 0.9, "signs"),
        Rule("long_words", share("word_chars", "n_words"), 6.0, 7.0, "signs"),
        Rule("short_words", share("word_chars", "n_words"), 4.6, 4.25, "signs"),
        Rule("capitals", share("n_upper", "n_letters"), 0.05, 0.2, "shouting"),
        Rule("marks", share("n_marks", "n_words"), 0.05, 0.2, "shouting"),
    ]


#: Below so many words, or with more than this percentage of words in repeats, a document fails outright.
LEAST_WORDS, MOST_REPEATS = 50, 50

#: Kept from this posterior on.
KEEP = 0.5


def measured(docs: DataFrame, p: str = "", columns: list[str] | None = None) -> DataFrame:
    """The given columns of ``docs`` (doc_id alone if none are) and COUNTS, named
    with ``p`` before, of each row's whole text; null texts count as empty. No
    shuffle."""
    columns = ["doc_id"] if columns is None else columns
    names = [*columns, *[p + c for c in COUNTS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in utf8_slices(batch.column(len(columns)), 2 << 20):
                raw, e = data.tobytes(), ends.tolist()
                got = counts_of([raw[x:y] for x, y in zip(e, e[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns[: len(columns)]], *[pa.array(got[c].astype(np.int64)) for c in COUNTS]], names=names)

    q = own_prefix(docs)
    df = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(f"{q}text"))
    schema = T.StructType([*df.schema.fields[:-1], *[T.StructField(p + c, T.LongType()) for c in COUNTS]])
    return df.mapInArrow(run, schema)


#: Where the estimate starts. Chances of a bad vote, of none and of a good one: by a rule of the bad class's
#: aspect, by any other rule in a bad class, and in the good class; the share of good documents; how many
#: documents' worth of it stay in the estimate.
OWN, OTHER, GOOD, START_GOOD, WORTH = (0.4, 0.1, 0.5), (0.05, 0.1, 0.85), (0.03, 0.07, 0.9), 0.8, 30.0


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], aspects: Sequence[str], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (votes, documents): the shares of the
    classes, and the chances (class, rule, vote) of each vote given the class.

    Class 0 is good; the others are bad, one for each aspect in order of first
    mention, as bad texts of one kind pass the rules made for the others. An
    abstention is a vote with chances of its own. Nothing holds the chances but
    WORTH documents of the start, so a rule whose bad votes no other bears out
    comes to be seen as often wrong, and a useless one as no better than chance.
    """
    n_rules, kinds = len(aspects), list(dict.fromkeys(aspects))
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), n_rules) + 1
    n = np.array([c for _, c in patterns], float)
    cast = (votes[:, :, None] == np.arange(3)).astype(float)
    start = np.empty((1 + len(kinds), n_rules, 3))
    start[0], start[1:] = GOOD, OTHER
    for r, aspect in enumerate(aspects):
        start[1 + kinds.index(aspect), r] = OWN
    shares = np.concatenate([[START_GOOD], np.full(len(kinds), (1 - START_GOOD) / len(kinds))])
    chance = start.copy()
    for _ in range(rounds if len(patterns) else 0):
        w = posteriors(votes, shares, chance) * n[:, None]
        old, chance = chance, (np.einsum("nc,nrv->crv", w, cast) + WORTH * start) / (w.sum(0)[:, None, None] + WORTH)
        shares = (w.sum(0) + 1) / (n.sum() + len(shares))
        if np.abs(chance - old).max() < 1e-9:
            break
    return shares, chance


def accuracies(shares: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """For each rule how often it votes bad on bad documents, and good on good ones."""
    bad = shares[1:] / shares[1:].sum()
    return np.stack([bad @ chance[1:, :, 0], chance[0, :, 2]], axis=1)


def posteriors(votes: np.ndarray, shares: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """(patterns, classes), for votes of 0 (bad), 1 (none) and 2 (good)."""
    score = np.log(shares) + np.log(chance[:, np.arange(votes.shape[1]), votes]).sum(2).T
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def estimate(counts: DataFrame, rs: Sequence[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """``reliabilities`` over all rows of ``counts``."""
    rows = counts.groupBy(F.concat_ws(",", *[r.vote() for r in rs]).alias("votes")).count().collect()  # at most 3**rules
    patterns = [(tuple(map(int, r["votes"].split(","))), r["count"]) for r in sorted(rows)]
    return reliabilities(patterns, [r.aspect for r in rs])


def verdicts(counts: DataFrame, p: str = "", keep: float = KEEP, rs: Sequence[Rule] | None = None) -> dict[str, Column]:
    """Expressions over COUNTS for quality (the posterior), base_failed and
    kept, with reliabilities estimated over all rows of ``counts``.

    A document without words fails the base and is not kept.
    """
    rs = rules(p) if rs is None else rs
    shares, chance = estimate(counts, rs)
    # a class's odds against the good one are a product over the votes: an expression, no lookup
    against = F.lit(0.0)
    ratio = np.log(chance / chance[0])
    for share, of_class in zip(np.log(shares / shares[0]).tolist()[1:], ratio.tolist()[1:], strict=True):
        score = F.lit(share)
        for r, (bad, none, good) in zip(rs, of_class, strict=True):
            score = score + F.when(r.vote() == 1, good).when(r.vote() == -1, bad).otherwise(none)
        against = against + F.exp(score)
    words, repeats = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATS * words)
    quality = 1 / (1 + against)
    return {"quality": quality, "base_failed": failed, "kept": ~failed & (quality >= keep)}


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, COUNTS, quality, base_failed, kept of each row of ``docs``.

    The texts are read once; their counts are written to the shared folder, and
    both the estimate and the verdicts read those. Repeated rows are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    counts = stored(measured(docs), "quality-counts")
    return counts.withColumns(verdicts(counts, keep=keep))


def filtered(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were, whatever their
    names. The texts are counted once and written with their counts, which costs
    less than counting them again; they are never shuffled. Null and empty texts
    go; repeated rows are judged alike; an empty table gives no rows."""
    p = own_prefix(docs)
    rows = stored(measured(docs, p, docs.columns), "quality-rows")
    return rows.filter(verdicts(rows, p, keep)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
