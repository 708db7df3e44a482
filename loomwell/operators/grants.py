"""Capability tokens and their checks."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verbs, and the ones that ``write`` stands for.
VERBS = ("read", "poll", "insert", "update", "delete", "ddl", "write")
WRITES = ("insert", "update", "delete", "ddl", "write")

#: The verbs that an engine action asks for; none for free actions, deny for others.
FREE, DENIED = ("select", "function", "transaction", "savepoint", "recursive"), ("pragma", "attach", "detach")
READERS = ("read", "insert", "update", "delete", "ddl")


def mint(secret: bytes, grants: list[dict], exp: int, sub: str | None = None, prefix: str = "cap") -> str:
    if not grants or any(not g.get("objects") or not set(g.get("verbs", ())) <= set(VERBS) for g in grants):
        raise ValueError("at least one grant, with objects and known verbs")
    body = json.dumps({"grants": grants, "exp": exp} | ({"sub": sub} if sub else {}), separators=(",", ":")).encode().hex()
    return f"{prefix}.{body}.{hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()}"


def verify(secret: bytes, token: str, now: int) -> dict | None:
    parts = token.split(".")
    if len(parts) != 3 or not hmac.compare_digest(hmac.new(secret, parts[1].encode(), hashlib.sha256).hexdigest(), parts[2]):
        return None
    try:
        cap = json.loads(bytes.fromhex(parts[1]))
    except ValueError:
        return None
    return cap if cap["exp"] > now else None


def verb_covered(asked: Column, verbs: Column) -> Column:
    """A verb is covered by itself; inserts, updates, deletes and DDL by ``write``
    too; ``write`` by any of the five."""
    some = F.arrays_overlap(verbs, F.array(*map(F.lit, WRITES)))
    return F.array_contains(verbs, asked) | (asked.isin(*WRITES[:4]) & F.array_contains(verbs, F.lit("write"))) | ((asked == "write") & some)


def object_covered(obj: Column, pattern: Column) -> Column:
    """Equal, or a prefix before one star at the end; other stars are literal."""
    return (obj == pattern) | (pattern.endswith("*") & obj.startswith(F.substring(pattern, F.lit(1), F.length(pattern) - 1)))


def allows(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (object, verb, ...) with ``allowed``. Exact patterns are an
    equi-join; a prefix meets the objects that begin with it through an
    equi-join too, on each length that the prefixes have."""
    p = F.col("pattern")
    g = grants.select("pattern", "verbs").withColumn("stem", F.when(p.endswith("*"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)).withColumn("open", p.endswith("*"))
    asked = requests.select("object", "verb").distinct()
    lengths = sorted(r[0] for r in g.filter("open").select(F.length("stem")).distinct().collect())  # 64 at most, as ids are
    stems = F.array(F.struct(F.col("object").alias("stem"), F.lit(False).alias("open")), *[F.struct(F.substring("object", F.lit(1), F.lit(n)).alias("stem"), F.lit(True).alias("open")) for n in lengths])
    hit = asked.withColumn("s", F.explode(stems)).select("object", "verb", "s.*").join(g, ["stem", "open"]).filter(verb_covered(F.col("verb"), F.col("verbs")) & object_covered(F.col("object"), p))
    return requests.join(hit.select("object", "verb", F.lit(True).alias("allowed")).distinct(), ["object", "verb"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def gate(action: Column, verbs: Column) -> Column:
    """Whether the verbs let an engine action through."""
    a = F.lower(action)
    return (
        F.when(a.isin(*FREE), True)
        .when(a.isin(*DENIED), False)
        .when(a == "read", F.arrays_overlap(verbs, F.array(*map(F.lit, (*READERS, "write")))))
        .when(a.isin("insert", "update", "delete"), verb_covered(a, verbs))
        .otherwise(verb_covered(F.lit("ddl"), verbs))
    )


#: What each route asks for.
ROUTES = {"txn": "write", "exec": "write", "query": "read", "poll": "poll", "objects": "root", "stats": "root", "grant": "root"}


def route_allowed(route: str, cap: dict | None, root: bool) -> bool:
    """The coarse check of a route; root may do all, and some routes are root's alone."""
    asks = ROUTES[route]
    if root:
        return True
    if cap is None or asks == "root":
        return False
    held = {v for g in cap["grants"] for v in g["verbs"]}
    return asks in held or (asks == "write" and bool(held & set(WRITES)))


def route_gate(route: Column, verbs: Column, root: Column) -> Column:
    """``route_allowed`` for many requests: the route, the verbs held (null without a token) and whether root asks."""
    asks = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])[route]
    held = F.arrays_overlap(verbs, F.array(*map(F.lit, WRITES)))
    mine = F.when(asks == "root", False).when(asks == "write", held | F.array_contains(verbs, F.lit("write"))).otherwise(F.array_contains(verbs, asks))
    return F.coalesce(F.when(root, asks.isNotNull()).otherwise(mine), F.lit(False))


def signature(body: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of a string in lower-case hex, from two hashes over the padded secret."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), body.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def minted(claims: Column, secret: bytes, prefix: str = "cap") -> Column:
    """Tokens of many claims (JSON text) at once, as ``mint`` makes them of one."""
    body = F.lower(F.hex(claims.cast("binary")))
    return F.concat_ws(".", F.lit(prefix), body, signature(body, secret))


def verified(token: Column, secret: bytes, now: Column) -> Column:
    """The claims of many tokens as JSON text; null for those that are malformed, forged or expired."""
    parts = F.split(token, "[.]")
    body = F.get(parts, F.lit(1))
    claims = F.try_to_binary(body, F.lit("hex")).cast("string")
    good = (F.size(parts) == 3) & (F.get(parts, F.lit(2)) == signature(body, secret)) & (F.get_json_object(claims, "$.exp").cast("long") > now)
    return F.when(good, claims)
