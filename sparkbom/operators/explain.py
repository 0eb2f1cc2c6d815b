"""Why an asset is there: the context of its use, its intent, the flow of its data and the way to it, each with a method, a confidence
and evidence. Decision tables over single rows, as column expressions; texts are compared without case.

Rows are those of :func:`sparkbom.operators.signals.assets` with an array ``chain``, the callers above the asset's function; null
functions and files count as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbom.operators.match import _any, _map

CERTIFICATE = ("certificate", "cert", "x509", "csr")


def with_chains(m: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds ``chain``: the longest chain of callers of the function, at least the function itself."""
    own = F.when(F.col("function").isNotNull(), F.array("function")).otherwise(F.array().cast("array<string>"))
    return m.join(chains.select("root", F.col("fn").alias("function"), F.col("chain").alias("above")), ["root", "function"], "left").withColumn("chain", F.coalesce("above", own)).drop("above")


def _known(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def _row(value: str | Column, method: str, confidence: float, *evidence: str | Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(value).alias("value"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.array(*map(text, evidence)).alias("evidence"))


def _texts() -> tuple[Column, Column, Column]:
    """The function's name, everything said about the asset, and its API; in lower case."""
    function, api = F.lower(_known("function")), F.lower("api")
    said = F.lower(F.concat_ws(" ", _known("function"), _known("file"), F.array_join("chain", " "), F.col("api"), F.col("algorithm"), F.col("primitive")))
    return function, said, api


def usage_context() -> Column:
    function, said, _ = _texts()
    p, has = F.col("primitive"), _any
    fallback = {
        "symmetric_encryption": "data_protection", "asymmetric_encryption": "key_exchange", "key_derivation": "key_management", "message_authentication": "integrity_verification",
        "random_generation": "random_material_generation", "hash": "hashing", "certificate_management": "certificate_management",
    }
    certificate = F.when(has(said, ("generate", "builder", "self_signed", "csr")), "certificate_generation").otherwise("certificate_management")
    signature = F.when(F.contains(function, F.lit("verify")), "signature_verification").otherwise("signature_generation")
    by = "function_name_pattern"
    return (
        F.when(has(said, CERTIFICATE), _row(certificate, "multi_signal_context", 0.92, "Certificate/X.509 signal from file, function, API, or algorithm"))
        .when(p.isin("asymmetric_key_generation", "symmetric_key_generation", "key_derivation") & has(said, ("key", "derive", "kdf", "generate")), _row("key_management", "primitive_and_context", 0.86, "Key-management primitive plus key/derive/generate context"))
        .when(has(function, ("auth", "login", "password", "hash")), _row("authentication_flow", by, 0.85, "Function name contains authentication keyword"))
        .when(has(function, ("encrypt", "cipher", "encode")), _row("data_protection", by, 0.9, "Function name contains encryption keyword"))
        .when(has(function, ("sign", "verify", "signature")), _row(signature, by, 0.9, "Function name contains signature keyword"))
        .when(has(function, ("random", "generate", "seed", "nonce")), _row("random_number_generation", by, 0.85, "Function name contains RNG keyword"))
        .when(p.isin(*fallback), _row(F.try_element_at(_map(fallback), p), "primitive_classification", 0.70, F.concat(F.lit("Derived from primitive type: "), p)))
        .otherwise(_row("general_cryptographic_operation", "fallback", 0.5, "No specific pattern detected"))
    )


def intent() -> Column:
    _, said, api = _texts()
    p, algorithm = F.col("primitive"), F.col("algorithm")
    builds = F.when(F.contains(api, F.lit("builder")), "build_certificate").otherwise("manage_certificate_lifecycle")
    made = p.isin("asymmetric_key_generation", "symmetric_key_generation")
    return (
        F.when((p == "certificate_management") | F.contains(api, F.lit("certificatebuilder")), _row(builds, "api_and_primitive", 0.92, "X.509 certificate builder or certificate management primitive"))
        .when(p.isin("certificate_request", "certificate_attribute", "certificate_extension"), _row("manage_certificate_lifecycle", "primitive_type", 0.86, "Certificate lifecycle support primitive"))
        .when((p == "key_serialization") | F.contains(api, F.lit("serialization.")), _row("key_material_serialization", "api_and_primitive", 0.9, "Key or certificate serialization API"))
        .when(made & _any(said, CERTIFICATE), _row("create_key_material", "primitive_and_certificate_context", 0.93, "Key generation occurs in certificate-related context"))
        .when(algorithm.isin("PBKDF2", "Scrypt", "Argon2", "bcrypt"), _row("derive_password_key", "algorithm_purpose", 0.95, F.concat(algorithm, F.lit(" is designed for password derivation"))))
        .when(algorithm.isin("HKDF", "KDF"), _row("derive_key_material", "algorithm_purpose", 0.9, "General-purpose key derivation function"))
        .when(p == "symmetric_encryption", _row("encrypt_data", "primitive_type", 0.85, "Symmetric encryption primitive"))
        .when(made, _row("create_key_material", "primitive_type", 0.9, "Key generation primitive"))
        .when((p == "random_generation") & _any(F.lower(F.array_join("args", " ")), ("salt", "iv")), _row("create_iv_or_salt", "argument_analysis", 0.8, "Random generation primitive", "Arguments suggest salt/IV generation"))
        .when(p == "random_generation", _row("create_random_material", "primitive_type", 0.8, "Random generation primitive"))
        .when(p == "message_authentication", _row("verify_data_integrity", "primitive_type", 0.85, "Message authentication primitive (HMAC)"))
        .when(p == "hash", _row("compute_hash_digest", "primitive_type", 0.80, "Hash function primitive"))
        .otherwise(_row("unspecified_cryptographic_operation", "fallback", 0.5, "Unable to determine specific intent"))
    )


def usage_intent() -> Column:
    """The intent that a bill states: coarser than the explained one, and known for every encryption."""
    _, said, api = _texts()
    p, algorithm = F.col("primitive"), F.lower("algorithm")
    has = lambda t, w: F.contains(t, F.lit(w))
    made = p.isin("asymmetric_key_generation", "symmetric_key_generation")
    return (
        F.when((p == "certificate_management") | has(api, "certificatebuilder"), F.when(has(api, "builder"), "build_certificate").otherwise("manage_certificate_lifecycle"))
        .when(p.isin("certificate_request", "certificate_attribute", "certificate_extension"), "manage_certificate_lifecycle").when((p == "key_serialization") | has(api, "serialization."), "key_material_serialization")
        .when(algorithm.isin("pbkdf2", "scrypt", "argon2", "bcrypt") & ~made, "derive_password_key").when(made, "create_key_material")
        .when(has(algorithm, "pbkdf") | has(algorithm, "kdf") | (p == "key_derivation"), "derive_key_material").when(p.isin("symmetric_encryption", "authenticated_encryption", "asymmetric_encryption"), "encrypt_data")
        .when(p == "random_generation", "create_random_material").when(p == "hash", "compute_hash_digest").when(p == "message_authentication", "verify_integrity").otherwise("general_cryptographic_operation")
    )


def data_flow() -> Column:
    """Distinct inputs in order of their discovery: classes of data that are told by words, then by the sources of the roles."""
    c = F.col
    told = ("function_parameter", "local_assignment", "hardcoded_constant", "object_property", "return_value", "derived_value", "external_input")
    key = F.coalesce(c("key_source").isin(*told), F.lit(False))
    classes = F.filter("classes", lambda x: x.isin("user_input", "generated_random") | ((x == "key_material") & key))
    sources = F.array(*(F.when(c(f"{r}_source").isin("derived_from_kdf", "generated_random", "hardcoded_constant"), c(f"{r}_source")).when(c(f"{r}_source") == "external_input", "user_input") for r in ("key", "data", "iv", "nonce", "salt", "randomness")))
    inputs = F.array_distinct(F.array_compact(F.concat(classes, sources, F.array(F.when(c("hardcoded"), "hardcoded_constant")))))
    has = lambda x: F.array_contains(inputs, x)
    evidence = F.array_compact(F.array(
        F.when(has("hardcoded_constant"), "Cryptographic material may be hardcoded in source"), F.when(has("user_input"), "User input flows to cryptographic operation"),
        F.when(has("generated_random"), "Cryptographically generated random material used"),
    ))
    return F.struct(F.struct(inputs.alias("input_sources"), c("sink_type").alias("output_destination")).alias("value"), F.lit("signal_flow_analysis").alias("method"), F.lit(0.75).alias("confidence"), evidence.alias("evidence"))


def derivation_path() -> Column:
    """Rows need ``callers`` and ``callees``, the numbers of both, beside the chain."""
    n, crosses = F.size("chain"), (F.col("callers") > 0) | (F.col("callees") > 0)
    say = lambda cond, *parts: F.when(cond, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    evidence = F.array_compact(F.array(
        say(n > 0, "Call chain depth: ", n.cast("string"), " function(s)"), say(n > 1, "Root function: ", F.get("chain", F.lit(0))), say(n > 1, "Cryptographic call in: ", F.get("chain", n - 1)),
        say(F.col("callers") > 0, "Function called by: ", F.col("callers").cast("string"), " caller(s)"), say(F.col("callees") > 0, "Function calls: ", F.col("callees").cast("string"), " other function(s)"),
        say(crosses, "Cross-function data flow detected"),
    ))
    value = F.struct(n.alias("call_depth"), crosses.alias("cross_function_flow"), F.get("chain", F.lit(0)).alias("entry_point"))
    return F.struct(value.alias("value"), F.lit("call_graph_analysis").alias("method"), F.lit(0.9).alias("confidence"), evidence.alias("evidence"))


def explained(m: DataFrame) -> DataFrame:
    """Adds the structs ``usage_context, intent, data_flow, derivation_path`` and the text ``usage_intent``."""
    return m.withColumns({"usage_context": usage_context(), "intent": intent(), "data_flow": data_flow(), "derivation_path": derivation_path(), "usage_intent": usage_intent()})
