"""What the arguments of matched calls are for, where their values come from, and the risk that follows from both.

Arguments become rows; the functions that hold the calls are joined once for their parameters and assignments. Everything is
column expressions over these rows, and one aggregation brings them back to the calls. Expressions are those that a printed
syntax tree shows: one simple statement on a line. The arguments of a nested call are read to three levels of brackets.

A call without arguments has no rows and no sources beyond those of its primitive. Null functions join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbom.functions import dims
from sparkbom.operators.graph import kind, nodes_of
from sparkbom.operators.match import UNKNOWN, _any, _map
from sparkbom.session import cut

# Quantifiers are possessive, so that long texts neither backtrack nor recurse.
_TEXT = r"""[bBrRuU]{0,2}(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_NUMBER = r"[-+]?(?:0[xXoObB][0-9a-fA-F_]+|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][-+]?\d++)?[jJ]?)"
_CONSTANT = rf"(?s)(?:{_TEXT}|{_NUMBER}|None|True|False|\.\.\.)"
_PLAIN = r"[^()\[\]{},'\"]++"
_INNER = r"[^()\[\]{}'\"]++"
_NESTED = rf"(?:{_PLAIN}|{_TEXT}|[(\[{{](?:{_INNER}|{_TEXT}|[(\[{{](?:{_INNER}|{_TEXT}|[(\[{{](?:{_INNER}|{_TEXT})*+[)\]}}])*+[)\]}}])*+[)\]}}])"


def is_literal(text: Column) -> Column:
    """Whether a text is a constant, a container of constants, or stands in one kind of quotes from end to end."""
    t = F.trim(text)
    quoted = (F.length(t) > 1) & ((t.startswith("'") & t.endswith("'")) | (t.startswith('"') & t.endswith('"')))
    rest = F.regexp_replace(t, _CONSTANT, "")
    return F.coalesce(quoted | ((t != "") & rest.rlike(r"^[\[\](){},:\s]*$")), F.lit(False))


def keyword_of(argument: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(argument, r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)), F.lit(""))


def value_of(argument: Column) -> Column:
    """An argument without its name."""
    return F.when(keyword_of(argument).isNotNull(), F.trim(F.regexp_replace(argument, r"^[^=]*=", ""))).otherwise(argument)


def bare(value: Column) -> Column:
    return F.regexp_extract(F.trim(value), r"^([^.\[]*)", 1)


def functions(nodes: DataFrame) -> DataFrame:
    """``(root, function, parameters, assignments)``: of equal names in one repository the latest row. assignments: name and value of
    every simple assignment in the printed code, in order."""
    lines = F.filter(F.split(F.coalesce("properties.code", F.lit("")), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]\w*(?:, [A-Za-z_]\w*)* = "))
    names = lambda x: F.split(F.trim(F.substring_index(x, " = ", 1)), ", ")
    pairs = F.flatten(F.transform(lines, lambda x: F.transform(names(x), lambda n: F.struct(n.alias("name"), F.regexp_replace(x, r"^[^=]* = ", "").alias("value")))))
    f = nodes.where(kind() == "function").withColumns({"parameters": F.col("properties.parameters"), "assignments": pairs})  # shorter than the code
    f = nodes_of(f, "root", "name", "parameters", "assignments").where("name is not null")
    row = F.struct("id", "parameters", "assignments")
    return f.groupBy("root", F.col("name").alias("function")).agg(F.max_by(row, "id").alias("r")).select("root", "function", "r.parameters", "r.assignments")


def _argument_of_call(value: Column, call: str, place: int) -> Column:
    """The positional argument of a call whose name ends in ``call``, if the value is that call."""
    before = rf"(?:\s*{_NESTED}*+,)" * place
    got = F.trim(F.regexp_extract(value, rf"(?is)^[\w.]*{call}\({before}\s*({_NESTED}++)(?:,.*)?\)$", 1))
    return F.when((got != "") & ~got.rlike(r"^\w+\s*=(?!=)"), got)


def _values_by_role() -> dict[str, Column]:
    """role -> the value that an argument holds for it: by its keyword, by its place in the call, or within a nested call."""
    c, lapi, at, value = F.col, F.lower("api"), F.col("index"), F.col("value")
    by_keyword = F.try_element_at(_map(dims.KEYWORD_ROLES), c("keyword"))
    modes = [f"modes.{m}" for m in ("cbc", "gcm", "ctr", "cfb", "ofb")]
    kdf = lapi.isin("hashlib.pbkdf2_hmac", "pbkdf2_hmac", "bcrypt.kdf")
    chacha = lapi.isin("algorithms.chacha20", "chacha20poly1305")
    first = at == 0
    by_place = (
        F.when(first & lapi.isin("aes.new", "algorithms.aes", "fernet", "hmac", "hmac.new"), "key").when(chacha, F.when(first, "key").when(at == 1, "nonce"))
        .when(first & lapi.isin(*modes), "iv").when(first & lapi.startswith("hashlib."), "data").when(kdf, F.when(at == 1, "data").when(at == 2, "salt"))
    )
    nested = {
        "key": F.coalesce(_argument_of_call(value, r"algorithms\.(?:aes|chacha20)", 0)),
        "nonce": _argument_of_call(value, r"algorithms\.chacha20", 1),
        "iv": _argument_of_call(value, r"modes\.(?:cbc|gcm|ctr|cfb|ofb)", 0),
    }
    plain = lambda r: F.when((by_keyword == r) | F.coalesce(by_place == r, F.lit(False)), value)
    return {r: F.coalesce(plain(r), nested[r]) if r in nested else plain(r) for r in dims.ROLES[:5]}


def _role() -> Column:
    """What an argument is for: by the call's signature, else by words in it, in order."""
    c, lapi, at, low = F.col, F.lower("api"), F.col("index"), F.lower("argument")
    has = lambda *w: _any(low, w)
    kw = c("keyword")
    skipped = F.coalesce(kw.isin(*dims.NO_ROLE), F.lit(False))
    none = F.lit(None).cast("string")
    modes = [f"modes.{m}" for m in ("cbc", "gcm", "ctr", "cfb", "ofb")]
    by_signature = (
        F.when(skipped, none).when(F.try_element_at(_map(dims.KEYWORD_ROLES), kw).isNotNull(), F.try_element_at(_map(dims.KEYWORD_ROLES), kw))
        .when((lapi == "aes.new") & (at == 0), "key").when((lapi == "aes.new") & (at >= 2) & has("iv", "nonce"), F.when(has("nonce"), "nonce").otherwise("iv"))
        .when(lapi.isin("algorithms.aes", "fernet", "hmac", "hmac.new") & (at == 0), "key").when(lapi.isin("algorithms.chacha20", "chacha20poly1305"), F.when(at == 0, "key").when(at == 1, "nonce"))
        .when(lapi.isin(*modes) & (at == 0), "iv").when(lapi.startswith("hashlib.") & (at == 0), "data")
        .when(lapi.isin("hashlib.pbkdf2_hmac", "pbkdf2_hmac", "bcrypt.kdf"), F.when(at == 1, "data").when(at == 2, "salt"))
        .when(lapi.isin("pbkdf2hmac", "hkdf", "scrypt", "argon2") & has("salt"), "salt").when(lapi.isin("pbkdf2hmac", "hkdf", "scrypt", "argon2") & has("password"), "data")
        .when(lapi == "cipher", F.when(c("key_value").isNotNull(), "key").when(c("iv_value").isNotNull(), "iv").when(c("nonce_value").isNotNull(), "nonce"))
    )
    by_words = (
        F.when(skipped, none).when(has("salt"), "salt").when(has("nonce"), "nonce").when(has("iv", *modes), "iv").when(has("random"), "randomness").when(has("token_bytes", "randbytes"), "randomness")
        .when(has("data", "payload", "message", "token", "note"), "data").when(has("key", "secret"), "key").when(has("password"), "data")
    )
    return F.coalesce(by_signature, by_words, F.concat(F.lit("arg_"), at.cast("string")))


def _origin(value: Column) -> Column:
    """``(kind, expression)`` of the parameter or the last assignment that a value's bare name has in its function; null if none."""
    name = bare(value)
    last = F.try_element_at(F.filter(F.coalesce("assignments", F.array().cast("array<struct<name:string,value:string>>")), lambda a: a["name"] == name), F.lit(-1))
    parameter = F.coalesce(F.array_contains("parameters", name), F.lit(False))
    made = lambda k, e: F.struct(F.lit(k).alias("kind"), e.alias("expression"))
    return F.when(parameter, made("function_parameter", F.lit(None).cast("string"))).when(last.isNotNull(), made("assignment", last["value"]))


def argument_signals(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per argument of a matched call: ``index, argument, keyword, value, role, <role>_value, semantic_value, is_literal,
    literal_origin, origin_kind, origin_expression, mode, padding, key_size`` beside ``id, api``, and the function's parameters and
    assignments."""
    a = m.select("id", "root", "function", "api", F.posexplode("args").alias("index", "argument"))
    a = a.withColumn("keyword", keyword_of(F.col("argument"))).withColumn("value", value_of(F.col("argument")))
    by = _values_by_role()
    a = a.withColumns({f"{r}_value": v for r, v in by.items()}).withColumn("role", _role())
    own = F.lit(None).cast("string")
    for r in by:
        own = F.when(F.col("role") == r, F.col(f"{r}_value")).otherwise(own)
    a = a.withColumn("semantic_value", F.coalesce(F.nullif(own, F.lit("")), "value"))
    a = a.join(functions(nodes), ["root", "function"], "left").withColumn("origin", _origin(F.col("semantic_value")))
    direct = is_literal(F.col("argument"))
    given = F.coalesce((F.col("origin.kind") == "assignment") & is_literal(F.col("origin.expression")), F.lit(False))
    size = F.replace(F.trim("argument"), F.lit("_"), F.lit("")).try_cast("int")
    return a.withColumns({
        "is_literal": direct | given, "literal_origin": F.when(direct, "argument_literal").when(given, "assignment_literal"), "origin_kind": F.col("origin.kind"), "origin_expression": F.col("origin.expression"),
        "mode": F.nullif(F.regexp_extract("argument", r"(?:MODE_|modes\.)(ECB|CBC|GCM|CTR|CFB|OFB)", 1), F.lit("")),
        "padding": F.get(F.filter(F.array(*(F.lit(p) for p in ("PKCS7", "OAEP", "PSS", "PKCS1v15"))), lambda p: F.contains(F.lower("argument"), F.lower(p))), F.lit(0)),
        "key_size": F.when(size.isin(64, 112, 128, 192, 2048, 3072, 4096) | size.between(256, 8192), size),
    }).drop("origin")


def expression_source(value: Column, kind_: Column, expression: Column, literal: Column) -> Column:
    """Where a value comes from, by its own text and the expression that its name was last given."""
    low, made = F.lower(value), F.lower(F.coalesce(expression, F.lit("")))
    own = lambda x: x.startswith("self.") | F.contains(x, F.lit(".self."))
    assigned = (
        F.when(_any(made, dims.RANDOM_WORDS), "generated_random").when(_any(made, dims.KDF_WORDS), "derived_from_kdf").when(is_literal(expression), "hardcoded_constant").when(own(made), "object_property")
        .when(_any(made, dims.DERIVED_WORDS), "derived_value").when(F.contains(made, F.lit("(")) & F.contains(made, F.lit(")")), "return_value").otherwise("local_assignment")
    )
    plain = F.when(_any(low, dims.RANDOM_WORDS), "generated_random").when(_any(low, dims.KDF_WORDS), "derived_from_kdf").when(literal, "hardcoded_constant").otherwise(UNKNOWN)
    return F.when(own(low), "object_property").when(kind_ == "function_parameter", "function_parameter").when(kind_ == "assignment", assigned).otherwise(plain)


def role_sources(signals: DataFrame) -> DataFrame:
    """``(id, index, role, literal, source)``: a row for each role that an argument plays or holds a value for."""
    held = {r: F.col(f"{r}_value") if r != "randomness" else F.lit(None).cast("string") for r in dims.ROLES}
    parts = F.array_compact(F.array(*(F.when((F.col("role") == r) | held[r].isNotNull(), F.struct(F.lit(r).alias("role"), held[r].alias("held"))) for r in dims.ROLES)))
    one = signals.withColumn("r", F.explode(parts)).withColumn("held", F.col("r.held")).withColumn("is_role", F.col("role") == F.col("r.role"))
    mine = F.struct(F.col("origin_kind").alias("kind"), F.col("origin_expression").alias("expression"))
    one = one.withColumn("origin", F.when(F.col("held").isNotNull(), _origin(F.col("held"))).when(F.col("origin_kind").isNotNull(), mine))
    kind_, expression = F.col("origin.kind"), F.col("origin.expression")
    given = F.coalesce((kind_ == "assignment") & is_literal(expression), F.lit(False))
    literal = F.when(F.col("is_role"), F.col("is_literal")).otherwise(is_literal(F.col("held")) | given)
    value = F.coalesce(F.nullif("held", F.lit("")), "semantic_value", "value")
    source = expression_source(value, kind_, expression, F.col("is_role") & F.col("is_literal"))
    return one.select("id", "index", F.col("r.role").alias("role"), literal.alias("literal"), source.alias("source"))


def source_mask(low: Column) -> Column:
    """Bits of the classes of data whose words stand in a text in lower case, in the order of the table; constants are told by other
    means. The text should be a column of its own, lest it be computed once per word."""
    out = F.lit(0).cast("long")
    for i, (_, name, words) in enumerate(dims.SOURCES):
        if name != "hardcoded_constant":
            out = out + F.when(_any(low, tuple(w.lower() for w in words)), 1 << i).otherwise(0)
    return out


def classes_of(mask: Column) -> Column:
    """The names of the classes in a mask, in order."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << i) > 0, name) for i, (_, name, _) in enumerate(dims.SOURCES))))


def scope_masks(m: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, scope)``: classes whose words stand in the function's name or in the code of any node with an edge into the call. The code
    is looked through once per node, not once per edge."""
    coded = nodes.withColumn("low", F.lower("properties.code")).withColumn("mask", source_mask(F.col("low")))
    coded = nodes_of(coded, "mask").where("mask > 0").withColumnRenamed("id", "source")
    into = edges.where("source is not null and target is not null").select("source", F.col("target").alias("id")).distinct()
    near = into.join(m.select("id"), "id", "left_semi").join(coded, "source").groupBy("id").agg(F.bit_or("mask").alias("near"))
    own = m.select("id", F.lower(F.coalesce("function", F.lit(""))).alias("low")).select("id", source_mask(F.col("low")).alias("own"))
    return own.join(near, "id", "left").select("id", F.col("own").bitwiseOR(F.coalesce("near", F.lit(0))).alias("scope"))


def flow_sources(m: DataFrame, nodes: DataFrame, edges: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """``(id, <role>_source..., sink_type, sink_id, hardcoded, classes)`` of every matched call. A source is null where the role does not
    apply to the primitive and ``unknown`` where nothing tells it. hardcoded: whether a key, vector, salt or datum is a literal."""
    signals = cut(argument_signals(m, nodes), "signals") if signals is None else signals
    told = role_sources(signals).groupBy("id").agg(
        *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in dims.ROLES), *(F.bool_or((F.col("role") == r) & F.col("literal")).alias(f"literal_{r}") for r in dims.ROLES),
        *(F.min_by("source", F.when((F.col("role") == r) & (F.col("source") != UNKNOWN), F.col("index"))).alias(f"from_{r}") for r in dims.ROLES),
    )
    said = signals.select("id", "is_literal", "role", F.lower("argument").alias("low")).select("id", "is_literal", "role", source_mask(F.col("low")).alias("mask"))
    hard = said.groupBy("id").agg(F.bool_or(F.col("is_literal") & F.col("role").isin("key", "iv", "salt", "data")).alias("hardcoded"), F.bit_or("mask").alias("said"))
    f = m.join(told, "id", "left").join(hard, "id", "left").join(scope_masks(m, nodes, edges), "id", "left")
    p, mode, c = F.col("primitive"), F.col("mode"), F.col
    classes = F.coalesce("said", F.lit(0)).bitwiseOR(F.coalesce("scope", F.lit(0)))
    place = {name: i for i, (_, name, _) in enumerate(dims.SOURCES)}
    spoken = lambda name: classes.bitwiseAND(1 << place[name]) > 0
    chacha = F.contains(F.lower("algorithm"), F.lit("chacha"))
    keyed = ("symmetric_encryption", "authenticated_encryption", "asymmetric_encryption", "key_derivation", "message_authentication")
    ciphers = ("symmetric_encryption", "authenticated_encryption", "cipher_mode")
    made = p.isin("asymmetric_key_generation", "symmetric_key_generation")
    applies = {
        "key": p.isin(*keyed) | F.contains(p, F.lit("key_generation")), "data": p.isin(*keyed, "hash", "password_hashing", "password_verification"),
        "iv": p.isin(*ciphers) & mode.isNotNull() & ~mode.isin("ECB", "stream") & ~chacha, "nonce": p.isin(*ciphers) & (mode.isin("stream", "GCM", "CTR", "CCM", "EAX", "SIV") | chacha),
        "salt": p.isin("key_derivation", "password_hashing"), "randomness": p.isin("random_generation", "symmetric_key_generation", "asymmetric_key_generation", "key_derivation"),
    }
    first = {
        "key": F.when(p == "key_derivation", "derived_from_kdf").when(made, "generated_random"), "nonce": None,
        "randomness": F.when((p == "random_generation") | spoken("generated_random") | made, "generated_random"),
    }
    last = {"key": F.when(spoken("key_material"), "external_input"), "data": F.when(spoken("user_input"), "external_input")}
    out = {}
    for r in dims.ROLES:
        told_ = F.when(F.coalesce(f"literal_{r}", F.lit(False)), "hardcoded_constant").otherwise(c(f"from_{r}"))
        source = F.coalesce(*(x for x in (first.get(r), told_, last.get(r), F.lit(UNKNOWN)) if x is not None))
        if r == "nonce":
            source = F.when((F.coalesce("n_nonce", F.lit(0)) > 0) | chacha, source)
        out[f"{r}_source"] = F.when(F.coalesce(applies[r], F.lit(False)), source)
    default = {"symmetric_encryption": "encryption_output", "authenticated_encryption": "encryption_output", "asymmetric_encryption": "encryption_output", "key_derivation": "derived_key", "hash": "hash_digest", "message_authentication": "mac_tag"}
    sink_id = F.lit(None).cast("string")
    sink_type = F.lit(None).cast("string")
    for key, name, primitives in reversed(dims.SINKS):
        sink_id, sink_type = F.when(p.isin(*primitives), key).otherwise(sink_id), F.when(p.isin(*primitives), name).otherwise(sink_type)
    out["sink_id"] = F.coalesce(sink_id, F.try_element_at(_map(default), p))
    out["sink_type"] = F.coalesce(sink_type, F.when(p.isin(*default), "cryptographic_output").otherwise(UNKNOWN))
    return f.select("id", *(v.alias(k) for k, v in out.items()), F.coalesce("hardcoded", F.lit(False)).alias("hardcoded"), classes_of(classes).alias("classes"))


def scored(m: DataFrame, flow: DataFrame) -> DataFrame:
    """Adds the sources of :func:`flow_sources`, risk, tags and confidence. Later steps overwrite earlier ones, so the order of the steps
    is part of the result."""
    c = F.col
    m = m.join(flow, "id", "left")
    no = F.lit(False)
    level = F.when(c("algorithm").isin(*dims.RISK_HIGH_ALGORITHMS) | F.coalesce(c("mode") == "ECB", no), "high").otherwise("low")
    rsa = F.coalesce(c("algorithm").isin("RSA", "RSA-OAEP") & (c("key_bits") < 2048), no)
    curve = F.coalesce(c("algorithm").isin("ECC", "ECDSA", "EdDSA") & (c("key_bits") < 256), no)
    few = F.coalesce((c("algorithm") == "PBKDF2") & (c("iterations") != 0) & (c("iterations") < 100000), no)
    ecb = F.coalesce((c("mode") == "ECB") | (c("algorithm") == "ECB"), no)
    cbc = F.coalesce((c("mode") == "CBC") & c("algorithm").isin("AES", "3DES", "DES", "Cipher"), no)
    loose = cbc & (c("iv_source").isNull() | c("iv_source").isin(UNKNOWN, "hardcoded_constant"))
    old = c("algorithm").isin(*dims.DEPRECATED)
    hard = F.coalesce("hardcoded", no)
    weak = c("api").isin("random.random", "random.randint", "random.choice")
    m = m.withColumn("l0", level)
    m = m.withColumn("l1", F.when(rsa, F.when(c("key_bits") < 1024, "high").otherwise("medium")).when(curve & (c("l0") == "low"), "medium").otherwise(c("l0")))
    m = m.withColumn("l2", F.when(old, "high").when(loose, "medium").when(ecb, "critical").when(few, "medium").otherwise(c("l1")))
    m = m.withColumn("risk", F.when(weak, "high").when(hard & (c("l2") == "low"), "medium").otherwise(c("l2"))).drop("l0", "l1", "l2")
    tag = lambda cond, name: F.when(cond, name)
    tags = F.array_compact(F.array(
        tag(rsa | curve, "weak_key_size"), tag(few, "low_iteration_count"), tag(ecb, "ecb_mode_detected"), tag(cbc, "cbc_requires_authentication_review"), tag(loose, "iv_source_unresolved"),
        tag(old, "deprecated_algorithm"), tag(hard, "hardcoded_material"), tag(weak, "weak_random_source"),
    ))
    base = F.when(ecb, 0.98).when(few, 0.85).otherwise(0.80)
    trust = F.when(c("provider").isNull(), dims.TRUST_NONE).otherwise(F.coalesce(F.try_element_at(_map(dims.TRUST), c("provider")), F.lit(dims.TRUST_OTHER)))
    return m.withColumns({"tags": tags, "confidence": F.least(F.lit(0.99), F.greatest(F.lit(0.5), base * trust))})


def assets(m: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Matched calls with their sources and their risk."""
    return scored(m, flow_sources(m, nodes, edges))
