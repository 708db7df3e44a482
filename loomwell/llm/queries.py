"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import factorisation, index, mixing, packing, pii, quality_rules, simhash, suffixes, token_files, urls
from loomwell.llm.common import scratch, table


def _number(kind: int) -> Column:
    """How many spans are of a kind. (A second parameter of the function would be the place in the array.)"""
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and spans; the base kinds' digest."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    n = [_number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    base = pii.written(F.filter(spans, lambda x: x["kind"] < 4))
    return found.select("doc_id", *n, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.written(spans).alias("spans"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factorisation.score(docs, factorisation.train(docs, table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.dedup(table(spark, sf_dir, "documents"), simhash.WORDS, simhash.RADIUS)
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digests(spark, path)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.removed(table(spark, sf_dir, "documents"))
    # what is left as text; bytes that no longer make a character are U+FFFD there
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document in training order, that of its first copy; ``positions`` has those of all copies taken."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    out = mixing.ordered(mixed, every=True).filter("mix_copy = 0")
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies", "mix.position", "mix.positions")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts of the kinds with exact definitions, which SQL can say too."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), weights=pii.NEVER)
    n = [_number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *n)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts and its base, without the posterior."""
    counts = quality_rules.measured(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < quality_rules.LEAST_WORDS) | (100 * F.col("n_repeat_words") > quality_rules.MOST_REPEATS * F.col("n_words"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 aims at: sizes and targets, without what the mix takes."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "mix.size", "mix.source_size", F.round("mix.target", 6).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_classifier, op3_simhash, op4_neighbours, op5_quality_rules, op6_token_files, op7_suffix_dedup, op8_url_filter, op9_packing, op10_mixing, pii_base_counts, quality_base_counts, mixing_targets)}


def _op8_sql() -> str:
    whens = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))" for _, h, p in whens]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, whens, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, whens, strict=True))
    bad = " OR ".join(f"full_url GLOB '{g.replace('?', '[?]')}'" if "?" in g else f"full_url GLOB '{g}'" for g in urls.BLOCK)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    # percent-encoded unreserved signs, one by one
    after = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    sign = "url_decode('%' || CASE WHEN regexp_matches(x, '^[2-7][0-9A-Fa-f]') THEN x[1:2] ELSE '20' END)"
    plain = (
        f"list_reduce(list_prepend(split_part({after}, '%', 1), list_transform(string_split({after}, '%')[2:], lambda x: CASE WHEN regexp_matches(x, '^[2-7][0-9A-Fa-f]') "
        f"AND contains('{urls.UNRESERVED}', {sign}) THEN {sign} || x[3:] ELSE '%' || x END)), lambda a, b: a || b)"
    )
    walk = "list_reduce(string_split(p, '/'), lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
    solid = f"{walk} || CASE WHEN regexp_matches(p, '/\\.\\.?$') OR {walk} = '' THEN '/' ELSE '' END"
    path = f"CASE WHEN p = '' THEN '/' WHEN regexp_matches(p, '/\\.\\.?(/|$)') THEN {solid} ELSE p END"
    site = r"regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '')"
    return (
        f"WITH u AS (SELECT page_id, url, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {lower.format(plain)} AS t FROM pages), "
        f"v AS (SELECT *, regexp_extract(t, '(?s)^([^?]*)', 1) AS p, regexp_extract(t, '(?s)^[^?]*(.*)$', 1) AS q FROM u), "
        f"w AS (SELECT *, CASE WHEN contains(coalesce(url, ''), '://') THEN {site} || {path} || q ELSE '' END AS full_url FROM v) "
        f"SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM w"
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _pii_sql() -> str:
    t, digits = "coalesce(text, '')", r"regexp_replace(s, '[^0-9]', '', 'g')"
    email = rf"len(regexp_extract_all({t}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))"
    ip = rf"len(list_filter(regexp_extract_all({t}, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda s: list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))))"
    d = f"cast(substr(reverse({digits}), i, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d} ELSE 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    card = rf"len(list_filter(regexp_extract_all({t}, '[0-9]([\x20-]?[0-9])+'), lambda s: length({digits}) BETWEEN 16 AND 19 AND {luhn}))"
    phone = rf"len(list_filter(regexp_extract_all({t}, '\+[0-9][\x20().0-9-]+[0-9]'), lambda s: length({digits}) BETWEEN 8 AND 15))"
    return f"SELECT doc_id, cast({email} AS BIGINT) AS n_email, cast({ip} AS BIGINT) AS n_ip, cast({card} AS BIGINT) AS n_card, cast({phone} AS BIGINT) AS n_phone FROM documents"


def _quality_sql() -> str:
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    return (
        f"WITH d AS (SELECT doc_id, {_WORDS} AS ws, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len({lines}) - len(list_distinct({lines})) AS n_dup_lines FROM documents), "
        "x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d), t AS (SELECT doc_id, p, w || ' ' || lead(w) OVER q || ' ' || lead(w, 2) OVER q AS g FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY p)), "
        "c AS (SELECT doc_id, g FROM t WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1), r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM t JOIN c USING (doc_id, g) CROSS JOIN (VALUES (0), (1), (2)) k(k) GROUP BY doc_id), "
        "o AS (SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)) "
        "SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o"
    )


def _mixing_sql() -> str:
    """The level at which the sources fill: that of the first, in filling order, that its own level leaves open."""
    return (
        f"WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS k, cast(len({_WORDS}) AS BIGINT) AS size FROM documents), s AS (SELECT k, sum(size) AS ss, row_number() OVER (ORDER BY k) - 1 AS rank FROM d GROUP BY k), "
        "c AS (SELECT *, 2.0 * ss AS cap, cast([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, 1.5 * sum(ss) OVER () AS wanted FROM s), "
        "f AS (SELECT *, cap / weight AS fills, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c), "
        "l AS (SELECT *, (wanted - before) / weights AS own FROM f), m AS (SELECT *, (SELECT arg_min(own, (fills, k)) FROM l WHERE own < fills) AS level FROM l) "
        "SELECT doc_id, size, cast(ss AS BIGINT) AS source_size, round(cast(CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS DOUBLE), 6) AS target FROM d JOIN m USING (k)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _op8_sql(), "pii_base_counts": _pii_sql(), "quality_base_counts": _quality_sql(), "mixing_targets": _mixing_sql()}
