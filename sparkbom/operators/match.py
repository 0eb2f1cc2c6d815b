"""Calls matched to crypto APIs, and what is read off a matched call alone: algorithm, mode, padding, key size, operation, class.

The API table is a dimension of fixed size, so it is a literal of the plan: each candidate name is cut into its dotted suffixes
and looked up, row by row, without a join. Null names match nothing; null arguments are no arguments. Arguments are positional
ones, then ``name=value`` in the order of the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbom.functions import dims
from sparkbom.operators.graph import calls_of

UNKNOWN = "unknown"


def _literal(v: object) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)


def _map(values: dict) -> Column:
    """A map as one literal of the plan."""
    return F.expr("map(" + ", ".join(_literal(x) for kv in values.items() for x in kv) + ")")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def with_arguments(calls: DataFrame) -> DataFrame:
    """Adds ``args``."""
    pairs = F.expr("transform(map_entries(keywords), e -> concat(e.key, '=', coalesce(e.value, '')))")
    none = F.array().cast("array<string>")
    return calls.withColumn("args", F.concat(F.coalesce("arguments", none), F.coalesce(pairs, none)))


def hits() -> Column:
    """``array<(rank, seq)>``: every API that the name (0), the resolved name (1) or the callee (2) ends in."""
    known = _map({row[1]: row[0] for row in dims.API_ROWS})

    def suffixes(name: Column, rank: Column) -> Column:
        parts = F.split(name, "[.]")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(rank.alias("rank"), F.try_element_at(known, F.array_join(F.slice(parts, i, F.size(parts)), ".")).alias("seq")))

    names = F.array(*(F.coalesce(c, F.lit("")) for c in ("name", "resolved_name", "callee")))
    return F.filter(F.flatten(F.transform(names, suffixes)), lambda h: h["seq"].isNotNull())


def _api(seq: Column) -> list[Column]:
    """The columns of the API table at a place."""
    names = ("seq", "api", "algorithm", "primitive", "provider")
    rows = ", ".join("named_struct(" + ", ".join(f"'{n}', {_literal(v)}" for n, v in zip(names, row)) + ")" for row in dims.API_ROWS)
    row = F.element_at(F.expr(f"array({rows})"), seq + 1)
    return [row[n].alias(n) for n in names[1:]]


def matches(calls: DataFrame) -> DataFrame:
    """All matches: ``(id, rank, seq, api)``."""
    hit = calls.select("id", F.explode(hits()).alias("h")).select("id", "h.rank", "h.seq")
    return hit.select("id", "rank", "seq", _api(F.col("seq"))[0])


def first_matches(calls: DataFrame) -> DataFrame:
    """One row per matched call, by the first candidate and then the first API, with the API's columns."""
    best = calls.withColumn("seq", F.array_min(hits())["seq"]).where("seq is not null")
    return best.select("*", *_api(F.col("seq")))


def unmatched(calls: DataFrame) -> DataFrame:
    return calls.where(F.size(hits()) == 0)


def matched(nodes: DataFrame) -> DataFrame:
    """Matched call nodes with their arguments and what can be read off them."""
    return described(with_arguments(first_matches(calls_of(nodes))))


def padding_of(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *w: _any(low, w)
    return F.when(has("oaep"), "OAEP").when(has("pss"), "PSS").when(has("pkcs1v15", "pkcs1_v1_5"), "PKCS1v15").when(has("pkcs7"), "PKCS7")


def digest_of(text: Column) -> Column:
    low = F.replace(F.lower(text), F.lit("_"), F.lit("-"))
    has = lambda *w: _any(low, w)
    return F.when(has("sha256", "sha-256"), "SHA-256").when(has("sha512", "sha-512"), "SHA-512").when(has("sha1", "sha-1"), "SHA-1").when(has("md5"), "MD5")


def curve_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"SECP(256|384|521)R1", 0), F.lit(""))


def whole_number(text: Column) -> Column:
    """The text as an integer, with or without underscores; null if it is none."""
    return F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("int")


def iterations_of(args: Column) -> Column:
    """The number after the equals sign of the first argument that speaks of iterations and has one."""
    named = F.filter(args, lambda a: F.contains(F.lower(a), F.lit("iterations")) & (F.size(F.split(a, "=")) == 2))
    return F.get(F.filter(F.transform(named, lambda a: whole_number(F.get(F.split(a, "="), F.lit(1)))), lambda n: n.isNotNull()), F.lit(0))


def size_signal(args: Column) -> Column:
    """The first argument that is a number and a usual key size."""
    sizes = F.transform(args, whole_number)
    return F.get(F.filter(sizes, lambda n: n.isin(64, 112, 128, 192, 2048, 3072, 4096) | n.between(256, 8192)), F.lit(0))


def key_bits(args: Column, algorithm: Column, primitive: Column) -> Column:
    """The key size in bits: a number that stands alone, else the first number that is a size of the algorithm, in bits or bytes."""
    numbers = F.transform(F.regexp_extract_all(F.array_join(args, " "), F.lit(r"\b\d{2,5}\b"), F.lit(0)), lambda x: x.cast("int"))
    keyed = algorithm.isin("AES", "ChaCha20", "Fernet", "HMAC", "HMAC-SHA-256", "HMAC-SHA-512")

    def size(n: Column) -> Column:
        return (
            F.when((algorithm == "RSA") & n.between(512, 8192), n).when(keyed & n.isin(16, 24, 32), n * 8).when(keyed & n.isin(128, 192, 256, 384, 512), n)
            .when((primitive == "key_derivation") & n.isin(16, 24, 32, 48, 64), n * 8)
        )

    alone = size_signal(args)
    return F.when((algorithm != "RSA") | alone.between(512, 8192), alone).otherwise(F.lit(None).cast("int")), F.get(F.filter(F.transform(numbers, size), lambda n: n.isNotNull()), F.lit(0))


def operation(api: Column, primitive: Column) -> Column:
    low = F.lower(api)
    has = lambda w: F.contains(low, F.lit(w))
    return F.when(has("decrypt"), "decryption").when(has("verify"), "verification").when(has("sign"), "signing").otherwise(F.coalesce(F.try_element_at(_map(dims.OPERATIONS), primitive), primitive))


def asset_class(primitive: Column, api: Column, algorithm: Column) -> Column:
    """``(asset_class, reason)``."""
    row = lambda c, r: F.struct(F.lit(c).alias("asset_class"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    return (
        F.when(primitive.isin(*dims.PRIMARY), row("primary_asset", F.concat(primitive, F.lit(" is a cryptographic operation"))))
        .when(primitive.isin(*dims.SUPPORTING), row("supporting_artifact", F.concat(primitive, F.lit(" supports primary crypto analysis"))))
        .when(api.startswith("x509.") | algorithm.startswith("X.509-"), row("supporting_artifact", "X.509 metadata object, not a cryptographic operation"))
        .when((primitive == "framework_plumbing") | algorithm.isin("Backend", "OpenSSL-Backend"), row("ignore", "Framework/backend plumbing"))
        .otherwise(row("supporting_artifact", "Crypto-related object without primary operation semantics"))
    )


def described(m: DataFrame) -> DataFrame:
    """Algorithm, primitive and provider of what a wrapper holds, and mode, padding, key size, operation and asset class. The
    columns of the API table stay as ``api_algorithm`` and ``api_primitive``. Where a field does not apply it is null, where it applies
    and is not found it is ``unknown``; ``key_bits`` is the key size as a number, null in both cases."""
    c = F.col
    cipher, keyed_hash = c("api") == "Cipher", c("api").isin("hmac.new", "HMAC")
    inner = F.lit(None).cast("string")
    for name, algorithm in reversed(dims.INNER):
        inner = F.when(c("text").rlike(rf"algorithms\.{name}\s*\("), algorithm).otherwise(inner)
    own = {"PKCS1_OAEP.new": ("RSA-OAEP", "asymmetric_encryption"), "rsa.generate_private_key": ("RSA", "asymmetric_key_generation"), "ec.generate_private_key": ("ECC", "asymmetric_key_generation"), "x509.CertificateBuilder": ("X.509", "certificate_management")}
    m = m.withColumn("text", F.array_join("args", " ")).withColumns({"api_algorithm": c("algorithm"), "api_primitive": c("primitive")})
    m = m.withColumns({
        "inner": F.when(cipher, inner), "digest": digest_of(c("text")), "curve": curve_of(c("text")), "iterations": iterations_of(c("args")),
        "said_mode": F.nullif(F.regexp_extract("text", rf"(?:MODE_|modes\.)({'|'.join(dims.MODES)})", 1), F.lit("")),
    })
    m = m.withColumns({
        "algorithm": F.when(cipher, F.coalesce("inner", "algorithm")).when(keyed_hash & c("digest").isNotNull(), F.concat(F.lit("HMAC-"), "digest")).otherwise(F.coalesce(F.try_element_at(_map({k: v[0] for k, v in own.items()}), c("api")), c("algorithm"))),
        "primitive": F.when(cipher, "symmetric_encryption").otherwise(F.coalesce(F.try_element_at(_map({k: v[1] for k, v in own.items()}), c("api")), c("primitive"))),
        "provider": F.when(cipher, F.coalesce("provider", F.lit("cryptography"))).otherwise(c("provider")),
    })
    no_mode = F.exists("args", lambda a: (F.trim(a) == "None") | F.contains(a, F.lit("mode=None")))
    stream = cipher & (c("algorithm") == "ChaCha20") & (no_mode | c("said_mode").isNull())
    of_api = F.coalesce(F.nullif(F.regexp_extract("api", rf"\.({'|'.join(dims.MODES)})$", 1), F.lit("")), F.when(c("api_algorithm").isin(*dims.MODES), c("api_algorithm")))
    mode = F.when(stream, "stream").when(cipher, c("said_mode")).otherwise(F.coalesce("said_mode", of_api))
    ciphers = ("symmetric_encryption", "authenticated_encryption", "asymmetric_encryption", "cipher_mode")
    sized = ("symmetric_encryption", "authenticated_encryption", "asymmetric_encryption", "key_derivation", "message_authentication", "asymmetric_key_generation")
    alone, read = key_bits(c("args"), c("algorithm"), c("primitive"))
    say = lambda cond, text: F.when(cond, text)
    evidence = F.array_compact(F.array(
        say(c("inner").isNotNull(), F.concat(F.lit("Resolved inner Cipher algorithm from arguments: "), "inner")), say(stream, F.lit("ChaCha20 treated as stream cipher semantics")),
        say(c("api") == "PKCS1_OAEP.new", F.lit("Mapped PKCS1_OAEP wrapper to RSA-OAEP")), say(keyed_hash & c("digest").isNotNull(), F.concat(F.lit("Resolved HMAC digest algorithm: "), "digest")),
        say((c("api") == "ec.generate_private_key") & c("curve").isNotNull(), F.concat(F.lit("Resolved elliptic curve argument: "), "curve")),
        say(c("api") == "x509.CertificateBuilder", F.lit("Mapped CertificateBuilder to certificate management")),
    ))
    m = m.withColumns({
        "mode": F.when(c("primitive").isin(*ciphers), F.coalesce(mode, F.lit(UNKNOWN))),
        "padding": F.when(c("primitive").isin("symmetric_encryption", "asymmetric_encryption"), F.coalesce(padding_of(c("text")), F.lit(UNKNOWN))),
        "key_bits": F.coalesce(alone, read), "operation": operation(c("api"), c("primitive")), "class": asset_class(c("primitive"), c("api"), c("algorithm")), "evidence": evidence,
    })
    m = m.withColumn("key_size", F.coalesce(c("key_bits").cast("string"), F.when(c("primitive").isin(*sized), UNKNOWN)))
    return m.select("*", c("class.asset_class").alias("asset_class"), c("class.reason").alias("class_reason")).drop("class", "text", "inner", "said_mode")


def rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in dims.LEVELS)), level)


def rule_matches(m: DataFrame) -> DataFrame:
    """``(id, seq, rule_id, priority, actionable, message, explanation)``: the conjunction of a rule's conditions, as a broadcast join
    with the rules, of which there is a fixed number."""
    r = F.broadcast(dims.rules(m.sparkSession))
    within = lambda items, c: (F.size(items) == 0) | F.coalesce(F.array_contains(items, F.col(c)), F.lit(False))
    left = m.select("id", F.col("algorithm").alias("own"), F.col("primitive").alias("what"), F.col("api").alias("call"), F.col("mode").alias("how"), "key_bits", "iterations")
    cond = within("algorithms", "own") & within("operations", "what") & within("apis", "call") & within("modes", "how") & within("matched", "own")
    cond = cond & (F.col("key_below").isNull() | (F.col("key_bits") < F.col("key_below"))) & (F.col("iterations_below").isNull() | ((F.col("iterations") < F.col("iterations_below")) & (F.col("iterations") != 0)))
    c, t = F.col, F.lit
    listed = lambda items: F.concat(t("["), F.array_join(F.transform(items, lambda x: F.concat(t("'"), x, t("'"))), ", "), t("]"))
    told = F.array_compact(F.array(F.when(F.size("algorithms") > 0, F.concat(t("algorithm_in="), listed("algorithms"))), F.when(F.size("operations") > 0, F.concat(t("operation_in="), listed("operations")))))
    is_ = lambda name: c("rule_id") == name
    text = (
        F.when(is_("AES_ECB_MODE"), "AES is used with ECB mode, which reveals patterns in encrypted data")
        .when(is_("PBKDF2_LOW_ITERATIONS"), F.concat(t("PBKDF2 configured with "), "iterations", t(" iterations; minimum 100,000 recommended")))
        .when(is_("RSA_SMALL_KEY"), F.concat(t("RSA key size "), "key_bits", t(" bits; minimum 2048 bits required")))
        .when(is_("WEAK_PRNG"), F.concat(t("Weak RNG "), "call", t(" used for cryptographic operation; use os.urandom()")))
        .when(is_("DEPRECATED_HASH"), F.concat("own", t(" is cryptographically broken; use SHA-256 or SHA-512")))
        .when(is_("ECB_MODE_OBJECT"), "ECB mode object instantiated; ECB should not be used for data encryption")
        .when(is_("LEGACY_BLOCK_CIPHER"), F.concat("own", t(" is deprecated; migrate to AES or ChaCha20")))
        .when(is_("HMAC_SHA256_USAGE"), "Rule HMAC_SHA256_USAGE matched: primitive=message_authentication")
        .when(F.size(told) > 0, F.concat(t("Rule "), "rule_id", t(" matched: "), F.array_join(told, ", ")))
        .otherwise(F.concat(t("Rule "), "rule_id", t(" matched cryptographic asset")))
    )
    return left.join(r, cond).select("id", "seq", "rule_id", "priority", "actionable", "message", text.alias("explanation"))


def rule_matches_v1(m: DataFrame) -> DataFrame:
    """``(id, seq, rule_id, risk, message)`` by the first profile: on the API's own algorithm and positional arguments. A condition that
    the profile does not know holds, so rules made of such conditions alone match every call."""
    r = F.broadcast(dims.rules_v1(m.sparkSession).withColumnRenamed("seq", "place"))
    within = lambda items, c: (F.size(items) == 0) | F.coalesce(F.array_contains(items, F.col(c)), F.lit(False))
    none = F.array().cast("array<string>")
    left = m.select("id", F.col("api_algorithm").alias("own"), F.col("api").alias("call"), F.coalesce("arguments", none).alias("given"), F.exists(F.coalesce("literal_types", none), lambda x: x == "str").alias("texts"))
    found = F.exists("contains", lambda w: F.exists("given", lambda a: F.contains(a, w)))
    small = F.expr("exists(given, a -> coalesce(try_cast(replace(trim(a), '_', '') as bigint) < number_below, false))")
    cond = within("apis", "call") & within("algorithms", "own") & ((F.size("contains") == 0) | found) & (F.col("number_below").isNull() | small) & (F.col("text_literal").isNull() | F.col("texts"))
    return left.join(r, cond).select("id", F.col("place").alias("seq"), "rule_id", "risk", "message")


def rule_group(priority: Column, actionable: Column) -> Column:
    return F.when(priority >= 80, "critical").when(actionable, "actionable").otherwise("informational")


def sink_of(primitive: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, name, primitives in reversed(dims.SINKS):
        out = F.when(primitive.isin(*primitives), name).otherwise(out)
    return out
