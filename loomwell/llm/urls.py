"""URL filter: all glob rules at once by a bit-parallel wildcard automaton.

A glob has literal characters, ``?`` (one character) and ``*`` (any run). Each
rule gets one bit a state; the states of all rules are packed into 64-bit
words. Reading a byte c is, for all rules together,

    D = ((D << 1) & B[c]) | (D & S[c])

B[c]: states that are entered by c, S[c]: states that c leaves standing (those
before a ``*``). A whole batch of URLs steps through its bytes side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.llm.common import own_prefix, utf8_slices

#: Host and path rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Globs over the canonical URL (host, path and query) that block a page which no rule above covers.
BLOCK = (
    "*cheap-pills*", "*casino*", "*viagra*", "*porn*", "*.xxx/*", "*/xxx/*", "*payday-loan*", "*free-money*", "*replica-watch*",
    "*/wp-login*", "*/cgi-bin/*", "*.exe", "*.zip", "*?sessionid=*", "*?phpsessid=*",
)

#: Rules that a table may hold: they are part of every task.
MOST_RULES = 100_000

_CONTINUED = np.arange(0x80, 0xC0)


@dataclass
class Automaton:
    """Shift-And masks of some globs: ``enter`` and ``stay`` by byte, (256, words)."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    last: list[tuple[int, np.uint64]]

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        states: list[tuple[int, list[int] | None, bool]] = []  # first of a glob?, bytes entering it (None: any), stays
        last = []
        for glob in globs:
            states.append([True, [], False, False])
            for ch in glob:
                if ch == "*":
                    states[-1][2] = True
                elif ch == "?":
                    states.append([False, None, False, True])
                else:
                    states += [[False, [b], False, False] for b in ch.encode()]
            last.append(len(states) - 1)
        words = max(1, -(-len(states) // 64))
        enter, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        for i, (first, by, stays, one) in enumerate(states):
            w, bit = divmod(i, 64)
            bit = np.uint64(1 << bit)
            if first:
                start[w] |= bit
            if by is None:  # a character is its first byte; the bytes that continue it leave the state standing
                enter[:, w] |= bit
                enter[_CONTINUED, w] &= ~bit
            elif by:
                enter[by, w] |= bit
            if stays:
                stay[:, w] |= bit
            elif one:
                stay[_CONTINUED, w] |= bit
        return cls(enter, stay, start, [(i // 64, np.uint64(1 << (i % 64))) for i in last])

    def match(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which glob matches which whole text: bool (texts, globs). Texts are
        stepped longest first, so each step touches only those that go on."""
        length = np.diff(ends)
        order = np.argsort(-length, kind="stable")
        begin, length = ends[:-1][order], length[order]
        d = np.tile(self.start, (len(order), 1))
        one, top = np.uint64(1), np.uint64(63)
        left = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for t, k in enumerate(left):
            now = d[:k]
            c = data[begin[:k] + t]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:k] = (moved & self.enter[c]) | (now & self.stay[c])
        out = np.zeros((len(order), len(self.last)), bool)
        for g, (w, bit) in enumerate(self.last):
            out[order, g] = (d[:, w] & bit) != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Signs that mean the same percent-encoded or not (RFC 3986, 2.3), by their codes.
UNRESERVED = "-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~"


def canonical(url: Column) -> Column:
    """Host, path and query without scheme, user, port and fragment: A-Z in lower
    case, unreserved signs decoded, ``.`` and ``..`` segments resolved, a final
    dot of the host gone. A host alone has the path ``/``. Empty for a null URL
    or one without ``://``."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "(?s)^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    # one pass over the parts between percent signs; two hex digits at a part's beginning are a sign
    after = F.split(F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^#]*)", 1), "%")

    def decoded(acc: Column, part: Column) -> Column:
        code = F.when(part.rlike("^[0-9A-Fa-f]{2}"), F.conv(F.substring(part, 1, 2), 16, 10).cast("int"))
        sign = F.when(code.between(0x21, 0x7E), F.chr(code))
        plain = sign.isNotNull() & F.contains(F.lit(UNRESERVED), sign)
        return F.concat(acc, F.when(plain, F.concat(sign, F.substring(part, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), part)))

    text = lower(F.when(F.size(after) > 1, F.aggregate(F.slice(after, 2, F.size(after)), F.get(after, 0), decoded)).otherwise(F.get(after, 0)))
    path, query = F.regexp_extract(text, r"(?s)^([^?]*)", 1), F.regexp_extract(text, r"(?s)^[^?]*(.*)$", 1)

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    # a path that ends in a dot segment ends in a slash
    solid = F.concat(F.array_join(walked, "/"), F.when(F.element_at(parts, -1).isin(".", "..") | (F.size(walked) == 1), "/").otherwise(""))
    path = F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), solid).otherwise(path)
    return F.when(F.contains(whole, F.lit("://")), F.concat(host, path, query)).otherwise("")


def of_table(rules: DataFrame) -> list[tuple[str, ...]]:
    """Rules kept as a table, (verdict, host, path) or (glob), for ``judge``: MOST_RULES at most, null rows left out."""
    rows = [tuple(r) for r in rules.dropna().distinct().limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block: Sequence[str] = BLOCK, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; no shuffle.

    The longest fitting host and path rule decides, on the URL as it is; without
    one, a page whose canonical URL a glob of ``block`` matches is blocked and
    every other allowed. A null URL or one without ``://`` has an empty host and
    path, no rule, and is allowed. Columns of those names that are there before
    are replaced; an empty table gives no rows. ``of_table`` reads rules from a
    table.
    """
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    # a host and path rule is two globs over "host<US>path": the host itself and its subdomains
    special = {"*": "", "?": ""}
    if any(ch in r[1] + r[2] for r in rules for ch in special):
        raise ValueError("hosts and paths of rules are literal")
    by_rule = Automaton.of([g for _, h, p in order for g in (f"{h}\x1f{p}*", f"*.{h}\x1f{p}*")])
    by_glob = Automaton.of(block)
    names = [f"{h}{p}" for _, h, p in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, hit = [], []
            for _, _, data, ends in utf8_slices(batch.column(at_site), 1 << 20):
                m = by_rule.match(data, ends)
                m = m[:, ::2] | m[:, 1::2]
                which.append(np.where(m.any(1), m.argmax(1), -1))
            for _, _, data, ends in utf8_slices(batch.column(at_full), 1 << 20):
                hit.append(by_glob.match(data, ends).any(1))
            which, hit = (np.concatenate(x) if x else np.zeros(0, int) for x in (which, hit))
            rule = pa.array([names[i] if i >= 0 else None for i in which], pa.string())
            verdict = pa.array([order[i][0] if i >= 0 else "block" if h else "allow" for i, h in zip(which, hit, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_site], rule, verdict], names=[*batch.schema.names[:at_site], "rule", "verdict"])

    p = own_prefix(pages)
    kept = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    df = kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    at_site, at_full = len(df.columns), len(df.columns) + 1
    schema = T.StructType(df.schema.fields)
    df = df.withColumns({f"{p}site": F.concat("host", F.lit("\x1f"), "path"), f"{p}full": canonical(F.col(url))})
    return df.mapInArrow(run, schema.add("rule", "string").add("verdict", "string"))
