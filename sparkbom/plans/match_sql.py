"""Oracle SQL of the queries on matched calls. Classes, operations, roles, words and texts stand here once more, in SQL, so that a slip in
the dimension tables shows; only the long lists of APIs, rules and words of sources are taken from there."""

from __future__ import annotations

from sparkbom.functions import dims

CALLS = """c AS (SELECT DISTINCT root, id, name, file, line, function, properties.resolved_name AS resolved_name, properties.callee AS callee,
coalesce(properties.arguments, []) AS arguments, properties.keywords AS keywords, [x.py_type FOR x IN coalesce(properties.literal_arguments, [])] AS literal_types FROM nodes WHERE lower(trim(kind)) = 'call' AND id IS NOT NULL)"""
BASE = f"""WITH {CALLS}, cand AS (SELECT id, 0 AS rank, name AS cand FROM c UNION ALL SELECT id, 1, resolved_name FROM c UNION ALL SELECT id, 2, callee FROM c),
hit AS (SELECT cand.id, cand.rank, m.seq, m.api FROM cand JOIN {dims.API_SQL} ON cand.cand = m.api OR ends_with(cand.cand, '.' || m.api)),
best AS (SELECT id, seq FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, seq) = 1),
m0 AS (SELECT c.*, m.api, m.algorithm, m.primitive, m.provider, arguments || [k || '=' || coalesce(keywords[k], '') FOR k IN coalesce(map_keys(keywords), [])] AS args
  FROM c JOIN best USING (id) JOIN {dims.API_SQL} ON m.seq = best.seq)"""
MODES = "ECB|CBC|GCM|CTR|CFB|OFB|EAX|SIV|CCM"
_dash = "replace(lower(text), '_', '-')"
FULL = BASE + rf""", m1 AS (SELECT *, array_to_string(args, ' ') AS text, algorithm AS api_algorithm, primitive AS api_primitive FROM m0),
m2 AS (SELECT *, CASE WHEN contains({_dash}, 'sha256') OR contains({_dash}, 'sha-256') THEN 'SHA-256' WHEN contains({_dash}, 'sha512') OR contains({_dash}, 'sha-512') THEN 'SHA-512' WHEN contains({_dash}, 'sha1') OR contains({_dash}, 'sha-1') THEN 'SHA-1' WHEN contains({_dash}, 'md5') THEN 'MD5' END AS digest,
 nullif(regexp_extract(text, 'SECP(256|384|521)R1'), '') AS curve, nullif(regexp_extract(text, '(?:MODE_|modes\.)({MODES})', 1), '') AS said,
 CASE WHEN api = 'Cipher' THEN CASE WHEN regexp_matches(text, 'algorithms\.AES\s*\(') THEN 'AES' WHEN regexp_matches(text, 'algorithms\.ChaCha20\s*\(') THEN 'ChaCha20' WHEN regexp_matches(text, 'algorithms\.ChaCha20Poly1305\s*\(') THEN 'ChaCha20-Poly1305'
  WHEN regexp_matches(text, 'algorithms\.TripleDES\s*\(') THEN '3DES' WHEN regexp_matches(text, 'algorithms\.Camellia\s*\(') THEN 'Camellia' WHEN regexp_matches(text, 'algorithms\.SEED\s*\(') THEN 'SEED' WHEN regexp_matches(text, 'algorithms\.CAST5\s*\(') THEN 'CAST5' WHEN regexp_matches(text, 'algorithms\.CAST6\s*\(') THEN 'CAST6' END END AS inner_alg,
 [TRY_CAST(replace(trim(list_extract(string_split(x, '='), 2)), '_', '') AS INTEGER) FOR x IN args IF contains(lower(x), 'iterations') AND len(string_split(x, '=')) = 2] AS its,
 [CAST(x AS INTEGER) FOR x IN regexp_extract_all(text, '\b\d{{2,5}}\b')] AS nums, [TRY_CAST(replace(trim(x), '_', '') AS INTEGER) FOR x IN args] AS whole FROM m1),
m3 AS (SELECT * REPLACE (CASE WHEN api = 'Cipher' THEN coalesce(inner_alg, algorithm) WHEN api IN ('hmac.new', 'HMAC') AND digest IS NOT NULL THEN 'HMAC-' || digest WHEN api = 'PKCS1_OAEP.new' THEN 'RSA-OAEP' WHEN api = 'rsa.generate_private_key' THEN 'RSA'
   WHEN api = 'ec.generate_private_key' THEN 'ECC' WHEN api = 'x509.CertificateBuilder' THEN 'X.509' ELSE algorithm END AS algorithm,
  CASE WHEN api = 'Cipher' THEN 'symmetric_encryption' WHEN api = 'PKCS1_OAEP.new' THEN 'asymmetric_encryption' WHEN api IN ('rsa.generate_private_key', 'ec.generate_private_key') THEN 'asymmetric_key_generation' WHEN api = 'x509.CertificateBuilder' THEN 'certificate_management' ELSE primitive END AS primitive,
  CASE WHEN api = 'Cipher' THEN coalesce(provider, 'cryptography') ELSE provider END AS provider), [x FOR x IN its IF x IS NOT NULL][1] AS iterations, [x FOR x IN whole IF x IN (64, 112, 128, 192, 2048, 3072, 4096) OR x BETWEEN 256 AND 8192][1] AS alone FROM m2),
m4 AS (SELECT *, api = 'Cipher' AND algorithm = 'ChaCha20' AND (said IS NULL OR len([x FOR x IN args IF trim(x) = 'None' OR contains(x, 'mode=None')]) > 0) AS stream,
 coalesce(nullif(regexp_extract(api, '\.({MODES})$', 1), ''), CASE WHEN regexp_full_match(api_algorithm, '{MODES}') THEN api_algorithm END) AS of_api,
 coalesce(CASE WHEN algorithm <> 'RSA' OR alone BETWEEN 512 AND 8192 THEN alone END, [y FOR y IN [CASE WHEN algorithm = 'RSA' AND x BETWEEN 512 AND 8192 THEN x WHEN algorithm IN ('AES', 'ChaCha20', 'Fernet', 'HMAC', 'HMAC-SHA-256', 'HMAC-SHA-512') AND x IN (16, 24, 32) THEN x * 8
  WHEN algorithm IN ('AES', 'ChaCha20', 'Fernet', 'HMAC', 'HMAC-SHA-256', 'HMAC-SHA-512') AND x IN (128, 192, 256, 384, 512) THEN x WHEN primitive = 'key_derivation' AND x IN (16, 24, 32, 48, 64) THEN x * 8 END FOR x IN nums] IF y IS NOT NULL][1]) AS key_bits FROM m3),
m AS (SELECT *, CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'cipher_mode') THEN coalesce(CASE WHEN stream THEN 'stream' WHEN api = 'Cipher' THEN said ELSE coalesce(said, of_api) END, 'unknown') END AS mode,
 CASE WHEN primitive IN ('symmetric_encryption', 'asymmetric_encryption') THEN CASE WHEN contains(lower(text), 'oaep') THEN 'OAEP' WHEN contains(lower(text), 'pss') THEN 'PSS' WHEN contains(lower(text), 'pkcs1v15') OR contains(lower(text), 'pkcs1_v1_5') THEN 'PKCS1v15' WHEN contains(lower(text), 'pkcs7') THEN 'PKCS7' ELSE 'unknown' END END AS padding,
 coalesce(CAST(key_bits AS VARCHAR), CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'key_derivation', 'message_authentication', 'asymmetric_key_generation') THEN 'unknown' END) AS key_size,
 CASE WHEN contains(lower(api), 'decrypt') THEN 'decryption' WHEN contains(lower(api), 'verify') THEN 'verification' WHEN contains(lower(api), 'sign') THEN 'signing' WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption') THEN 'encryption'
  WHEN primitive IN ('symmetric_key_generation', 'asymmetric_key_generation') THEN 'key_generation' WHEN primitive = 'hash' THEN 'digest' WHEN primitive = 'message_authentication' THEN 'authentication' WHEN primitive = 'cipher_mode' THEN 'mode_selection' WHEN primitive = 'digital_signature' THEN 'signing' ELSE primitive END AS operation,
 CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'symmetric_key_generation', 'asymmetric_key_generation', 'key_derivation', 'hash', 'message_authentication', 'random_generation', 'digital_signature', 'certificate_management', 'password_hashing', 'password_verification') THEN 'primary_asset'
  ELSE 'supporting_artifact' END AS asset_class,
 array_to_string([x FOR x IN [CASE WHEN inner_alg IS NOT NULL THEN 'Resolved inner Cipher algorithm from arguments: ' || inner_alg END, CASE WHEN stream THEN 'ChaCha20 treated as stream cipher semantics' END, CASE WHEN api = 'PKCS1_OAEP.new' THEN 'Mapped PKCS1_OAEP wrapper to RSA-OAEP' END,
  CASE WHEN api IN ('hmac.new', 'HMAC') AND digest IS NOT NULL THEN 'Resolved HMAC digest algorithm: ' || digest END, CASE WHEN api = 'ec.generate_private_key' AND curve IS NOT NULL THEN 'Resolved elliptic curve argument: ' || curve END, CASE WHEN api = 'x509.CertificateBuilder' THEN 'Mapped CertificateBuilder to certificate management' END] IF x IS NOT NULL], '; ') AS evidence FROM m4)"""

_CONST = r"""(?s)(?:[bBrRuU]{0,2}(?:''[^''\\]*(?:\\.[^''\\]*)*''|"[^"\\]*(?:\\.[^"\\]*)*")|[-+]?(?:0[xXoObB][0-9a-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?[jJ]?)|None|True|False|\.\.\.)"""
_PART = r"""(?:[^()\[\]{},''"]+|'[^']*'|"[^"]*"|[(\[{](?:[^()\[\]{}]+|[(\[{](?:[^()\[\]{}]+|[(\[{][^()\[\]{}]*[)\]}])*[)\]}])*[)\]}])""".replace("'[^']*'", "''[^'']*''")


def _lit(x: str) -> str:
    t = f"trim({x})"
    return rf"""coalesce((len({t}) > 1 AND ((starts_with({t}, '''') AND ends_with({t}, '''')) OR (starts_with({t}, '"') AND ends_with({t}, '"')))) OR ({t} <> '' AND regexp_matches(regexp_replace({t}, '{_CONST}', '', 'g'), '^[\[\](){{}},:\s]*$')), false)"""


def _call(name: str, place: int) -> str:
    before = rf"\s*{_PART}*," * place
    got = rf"nullif(trim(regexp_extract(value, '(?is)^[\w.]*{name}\({before}\s*({_PART}+)(?:,.*)?\)$', 1)), '')"
    return rf"CASE WHEN NOT coalesce(regexp_matches({got}, '^\w+\s*=([^=]|$)'), false) THEN {got} END"


def _any(text: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split(" ")) + ")"


def _mask(text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower({text}), {w.lower()!r})' for w in words)} THEN {1 << i} ELSE 0 END" for i, (_, name, words) in enumerate(dims.SOURCES) if name != "hardcoded_constant") + ")"


def _names(mask: str) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {mask} & {1 << i} > 0 THEN '{name}' END" for i, (_, name, _) in enumerate(dims.SOURCES)) + "] IF x IS NOT NULL]"


def _line(value: str) -> str:
    """The last assignment of a value's bare name in the function."""
    return rf"[x FOR x IN lines IF list_contains(string_split(trim(split_part(x, ' = ', 1)), ', '), regexp_extract(trim({value}), '^([^.\[]*)', 1))][-1]"


_param = lambda value: rf"coalesce(list_contains(parameters, regexp_extract(trim({value}), '^([^.\[]*)', 1)), false)"
KWROLE = "CASE WHEN kw IN ('key', 'secret') THEN 'key' WHEN kw IN ('password', 'passphrase', 'data', 'msg', 'message') THEN 'data' WHEN kw IN ('salt', 'iv', 'nonce') THEN kw END"
SKIP = "kw IN ('key_size', 'public_exponent', 'backend', 'mode', 'length', 'iterations')"
MODECALL = "lapi IN ('modes.cbc', 'modes.gcm', 'modes.ctr', 'modes.cfb', 'modes.ofb')"
PLACE = f"""CASE WHEN idx = 0 AND lapi IN ('aes.new', 'algorithms.aes', 'fernet', 'hmac', 'hmac.new') THEN 'key' WHEN lapi IN ('algorithms.chacha20', 'chacha20poly1305') THEN CASE idx WHEN 0 THEN 'key' WHEN 1 THEN 'nonce' END WHEN idx = 0 AND {MODECALL} THEN 'iv'
 WHEN idx = 0 AND starts_with(lapi, 'hashlib.') THEN 'data' WHEN lapi IN ('hashlib.pbkdf2_hmac', 'pbkdf2_hmac', 'bcrypt.kdf') THEN CASE idx WHEN 1 THEN 'data' WHEN 2 THEN 'salt' END END"""
SIGNALS = (
    FULL
    + rf""", fn AS (SELECT root, name AS function, arg_max(properties, id) AS p FROM (SELECT DISTINCT root, name, id, properties FROM nodes WHERE lower(trim(kind)) = 'function' AND name IS NOT NULL AND id IS NOT NULL) GROUP BY 1, 2),
fi AS (SELECT root, function, p.parameters AS parameters, [x FOR x IN string_split(coalesce(p.code, ''), chr(10)) IF regexp_matches(x, '^\s*[A-Za-z_]\w*(?:, [A-Za-z_]\w*)* = ')] AS lines FROM fn),
s0 AS (SELECT id, root, function, api, lower(api) AS lapi, unnest(range(len(args))) AS idx, args FROM m),
s1 AS (SELECT * EXCLUDE (args), args[idx + 1] AS argument, lower(args[idx + 1]) AS low, nullif(lower(regexp_extract(args[idx + 1], '^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=', 1)), '') AS kw FROM s0),
s2 AS (SELECT *, CASE WHEN kw IS NOT NULL THEN trim(regexp_replace(argument, '^[^=]*=', '')) ELSE argument END AS value, {KWROLE} AS kwrole, {PLACE} AS placed FROM s1),
s3 AS (SELECT *, {', '.join(f"coalesce(CASE WHEN kwrole = '{r}' OR placed = '{r}' THEN value END{x}) AS {r}_value" for r, x in (("key", ", " + _call(r"algorithms\.(?:aes|chacha20)", 0)), ("data", ""), ("iv", ", " + _call(r"modes\.(?:cbc|gcm|ctr|cfb|ofb)", 0)), ("nonce", ", " + _call(r"algorithms\.chacha20", 1)), ("salt", "")))} FROM s2),
s4 AS (SELECT *, coalesce(CASE WHEN {SKIP} THEN NULL WHEN kwrole IS NOT NULL THEN kwrole WHEN lapi = 'aes.new' AND idx = 0 THEN 'key' WHEN lapi = 'aes.new' AND idx >= 2 AND {_any('low', 'iv nonce')} THEN CASE WHEN contains(low, 'nonce') THEN 'nonce' ELSE 'iv' END
  WHEN lapi IN ('algorithms.aes', 'fernet', 'hmac', 'hmac.new') AND idx = 0 THEN 'key' WHEN lapi IN ('algorithms.chacha20', 'chacha20poly1305') THEN CASE idx WHEN 0 THEN 'key' WHEN 1 THEN 'nonce' END WHEN {MODECALL} AND idx = 0 THEN 'iv' WHEN starts_with(lapi, 'hashlib.') AND idx = 0 THEN 'data'
  WHEN lapi IN ('hashlib.pbkdf2_hmac', 'pbkdf2_hmac', 'bcrypt.kdf') THEN CASE idx WHEN 1 THEN 'data' WHEN 2 THEN 'salt' END WHEN lapi IN ('pbkdf2hmac', 'hkdf', 'scrypt', 'argon2') AND contains(low, 'salt') THEN 'salt' WHEN lapi IN ('pbkdf2hmac', 'hkdf', 'scrypt', 'argon2') AND contains(low, 'password') THEN 'data'
  WHEN lapi = 'cipher' THEN CASE WHEN key_value IS NOT NULL THEN 'key' WHEN iv_value IS NOT NULL THEN 'iv' WHEN nonce_value IS NOT NULL THEN 'nonce' END END,
 CASE WHEN {SKIP} THEN NULL WHEN contains(low, 'salt') THEN 'salt' WHEN contains(low, 'nonce') THEN 'nonce' WHEN {_any('low', 'iv modes.cbc modes.gcm modes.ctr modes.cfb modes.ofb')} THEN 'iv' WHEN {_any('low', 'random urandom token_bytes randbytes')} THEN 'randomness'
  WHEN {_any('low', 'data payload message token note')} THEN 'data' WHEN {_any('low', 'key secret')} THEN 'key' WHEN contains(low, 'password') THEN 'data' END, 'arg_' || idx) AS role FROM s3),
s5 AS (SELECT s4.*, coalesce(nullif(CASE role WHEN 'key' THEN key_value WHEN 'data' THEN data_value WHEN 'iv' THEN iv_value WHEN 'nonce' THEN nonce_value WHEN 'salt' THEN salt_value END, ''), value) AS semantic_value, fi.parameters, coalesce(fi.lines, []) AS lines FROM s4 LEFT JOIN fi ON fi.root = s4.root AND fi.function = s4.function),
s6 AS (SELECT *, {_param('semantic_value')} AS is_param, {_line('semantic_value')} AS line FROM s5),
s7 AS (SELECT *, CASE WHEN is_param THEN 'function_parameter' WHEN line IS NOT NULL THEN 'assignment' END AS origin_kind, CASE WHEN NOT is_param THEN regexp_replace(line, '^[^=]* = ', '') END AS origin_expression, {_lit('argument')} AS direct FROM s6),
s AS (SELECT *, direct OR {_lit('origin_expression')} AS is_literal, CASE WHEN direct THEN 'argument_literal' WHEN {_lit('origin_expression')} THEN 'assignment_literal' END AS literal_origin, nullif(regexp_extract(argument, '(?:MODE_|modes\.)(ECB|CBC|GCM|CTR|CFB|OFB)', 1), '') AS said_mode,
 CASE WHEN contains(low, 'pkcs7') THEN 'PKCS7' WHEN contains(low, 'oaep') THEN 'OAEP' WHEN contains(low, 'pss') THEN 'PSS' WHEN contains(low, 'pkcs1v15') THEN 'PKCS1v15' END AS said_padding, TRY_CAST(replace(trim(argument), '_', '') AS INTEGER) AS n FROM s7)"""
)


def _source(value: str, kind: str, expression: str, literal: str) -> str:
    made, low = f"lower(coalesce({expression}, ''))", f"lower({value})"
    random, kdf = "os.urandom urandom secrets. token_bytes token_hex token_urlsafe randbytes random_serial_number", "derive kdf pbkdf scrypt argon hkdf bcrypt.kdf"
    return f"""CASE WHEN starts_with({low}, 'self.') OR contains({low}, '.self.') THEN 'object_property' WHEN {kind} = 'function_parameter' THEN 'function_parameter' WHEN {kind} = 'assignment' THEN CASE WHEN {_any(made, random)} THEN 'generated_random' WHEN {_any(made, kdf)} THEN 'derived_from_kdf'
 WHEN {_lit(expression)} THEN 'hardcoded_constant' WHEN starts_with({made}, 'self.') OR contains({made}, '.self.') THEN 'object_property' WHEN {_any(made, '+ ^ hash sha digest encode decode [ ] concat')} THEN 'derived_value' WHEN contains({made}, '(') AND contains({made}, ')') THEN 'return_value' ELSE 'local_assignment' END
 WHEN {_any(low, random)} THEN 'generated_random' WHEN {_any(low, kdf)} THEN 'derived_from_kdf' WHEN {literal} THEN 'hardcoded_constant' ELSE 'unknown' END"""


def _part(role: str) -> str:
    if role == "randomness":
        return f"SELECT id, idx, 'randomness' AS role, is_literal AS literal, {_source('semantic_value', 'origin_kind', 'origin_expression', 'is_literal')} AS source FROM s WHERE role = 'randomness'"
    held = f"{role}_value"
    return f"""SELECT id, idx, '{role}', CASE WHEN own THEN is_literal ELSE {_lit(held)} OR {_lit('hx')} END, {_source('v', 'hk', 'hx', 'own AND is_literal')} FROM
(SELECT *, role = '{role}' AS own, coalesce(nullif({held}, ''), semantic_value) AS v, CASE WHEN {held} IS NULL THEN origin_kind WHEN {_param(held)} THEN 'function_parameter' WHEN {_line(held)} IS NOT NULL THEN 'assignment' END AS hk,
 CASE WHEN {held} IS NULL THEN origin_expression WHEN NOT {_param(held)} THEN regexp_replace({_line(held)}, '^[^=]* = ', '') END AS hx FROM s WHERE role = '{role}' OR {held} IS NOT NULL)"""


_ROLES = ("key", "data", "iv", "nonce", "salt", "randomness")
_CIPHER = "primitive IN ('symmetric_encryption', 'authenticated_encryption', 'cipher_mode')"
_KEYED = "'symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'key_derivation', 'message_authentication'"
_made = "primitive IN ('asymmetric_key_generation', 'symmetric_key_generation')"
_told = lambda r: f"CASE WHEN coalesce(lit_{r}, false) THEN 'hardcoded_constant' ELSE from_{r} END"
FLOW = (
    SIGNALS
    + ", rs AS ("
    + " UNION ALL ".join(_part(r) for r in ("randomness", *_ROLES[:5]))
    + f"""), told AS (SELECT id, {', '.join(f"count(*) FILTER (role = '{r}') AS n_{r}, coalesce(bool_or(literal) FILTER (role = '{r}'), false) AS lit_{r}, arg_min(source, idx) FILTER (role = '{r}' AND source <> 'unknown') AS from_{r}" for r in _ROLES)} FROM rs GROUP BY id),
hard AS (SELECT id, bool_or(is_literal AND role IN ('key', 'iv', 'salt', 'data')) AS hardcoded, bit_or({_mask('argument')}) AS said FROM s GROUP BY id),
near AS (SELECT e.target AS id, bit_or({_mask('n.code')}) AS near FROM (SELECT DISTINCT source, target FROM edges WHERE source IS NOT NULL AND target IS NOT NULL) e JOIN (SELECT DISTINCT id, properties.code AS code FROM nodes WHERE id IS NOT NULL AND properties.code IS NOT NULL) n ON n.id = e.source GROUP BY 1),
f0 AS (SELECT m.*, told.* EXCLUDE (id), coalesce(hardcoded, false) AS hardcoded, coalesce(said_2, 0) | {_mask("coalesce(m.function, '')")} | coalesce(near, 0) AS mask, contains(lower(algorithm), 'chacha') AS chacha
 FROM m LEFT JOIN told USING (id) LEFT JOIN (SELECT id, hardcoded, said AS said_2 FROM hard) h USING (id) LEFT JOIN near USING (id)),
flow AS (SELECT *, CASE WHEN primitive IN ({_KEYED}) OR contains(primitive, 'key_generation') THEN coalesce(CASE WHEN primitive = 'key_derivation' THEN 'derived_from_kdf' WHEN {_made} THEN 'generated_random' END, {_told('key')}, CASE WHEN mask & 2 > 0 THEN 'external_input' END, 'unknown') END AS key_source,
 CASE WHEN primitive IN ({_KEYED}, 'hash', 'password_hashing', 'password_verification') THEN coalesce({_told('data')}, CASE WHEN mask & 1 > 0 THEN 'external_input' END, 'unknown') END AS data_source,
 CASE WHEN {_CIPHER} AND mode IS NOT NULL AND mode NOT IN ('ECB', 'stream') AND NOT chacha THEN coalesce({_told('iv')}, 'unknown') END AS iv_source,
 CASE WHEN {_CIPHER} AND (coalesce(mode IN ('stream', 'GCM', 'CTR', 'CCM', 'EAX', 'SIV'), false) OR chacha) AND (coalesce(n_nonce, 0) > 0 OR chacha) THEN coalesce({_told('nonce')}, 'unknown') END AS nonce_source,
 CASE WHEN primitive IN ('key_derivation', 'password_hashing') THEN coalesce({_told('salt')}, 'unknown') END AS salt_source,
 CASE WHEN primitive IN ('random_generation', 'symmetric_key_generation', 'asymmetric_key_generation', 'key_derivation') THEN coalesce(CASE WHEN primitive = 'random_generation' OR mask & 4 > 0 OR {_made} THEN 'generated_random' END, {_told('randomness')}, 'unknown') END AS randomness_source,
 CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'hash', 'message_authentication', 'key_derivation') THEN 'crypto_sink' WHEN primitive IN ('symmetric_key_generation', 'asymmetric_key_generation', 'random_generation') THEN 'key_material_sink' WHEN primitive = 'digital_signature' THEN 'signature_sink'
  WHEN primitive IN ('certificate_management', 'certificate_request', 'certificate_attribute', 'certificate_extension') THEN 'certificate_sink' ELSE 'unknown' END AS sink_type,
 CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'hash', 'message_authentication', 'key_derivation') THEN 'crypto_operation' WHEN primitive IN ('symmetric_key_generation', 'asymmetric_key_generation', 'random_generation') THEN 'key_generation' WHEN primitive = 'digital_signature' THEN 'signature_operation'
  WHEN primitive IN ('certificate_management', 'certificate_request', 'certificate_attribute', 'certificate_extension') THEN 'certificate_operation' END AS sink_id FROM f0)"""
)
RISK = (
    FLOW
    + """, r0 AS (SELECT *, algorithm IN ('RSA', 'RSA-OAEP') AND coalesce(key_bits < 2048, false) AS rsa, algorithm IN ('ECC', 'ECDSA', 'EdDSA') AND coalesce(key_bits < 256, false) AS ecc, algorithm = 'PBKDF2' AND coalesce(iterations <> 0 AND iterations < 100000, false) AS few,
 coalesce(mode, '') = 'ECB' OR algorithm = 'ECB' AS ecb, coalesce(mode = 'CBC', false) AND algorithm IN ('AES', '3DES', 'DES', 'Cipher') AS cbc, algorithm IN ('DES', '3DES', 'MD5', 'SHA-1') AS old, api IN ('random.random', 'random.randint', 'random.choice') AS weak FROM flow),
r1 AS (SELECT *, cbc AND coalesce(iv_source IN ('unknown', 'hardcoded_constant'), true) AS loose FROM r0),
r2 AS (SELECT *, CASE WHEN old THEN 'high' WHEN loose THEN 'medium' WHEN ecb THEN 'critical' WHEN few THEN 'medium' WHEN rsa AND key_bits < 1024 THEN 'high' WHEN rsa THEN 'medium' WHEN algorithm IN ('MD5', 'SHA-1', 'DES', '3DES', 'ECB', 'Random') OR coalesce(mode = 'ECB', false) THEN 'high' WHEN ecc THEN 'medium' ELSE 'low' END AS base FROM r1),
r AS (SELECT *, CASE WHEN weak THEN 'high' WHEN hardcoded AND base = 'low' THEN 'medium' ELSE base END AS risk, array_to_string([x FOR x IN [CASE WHEN rsa OR ecc THEN 'weak_key_size' END, CASE WHEN few THEN 'low_iteration_count' END, CASE WHEN ecb THEN 'ecb_mode_detected' END, CASE WHEN cbc THEN 'cbc_requires_authentication_review' END,
 CASE WHEN loose THEN 'iv_source_unresolved' END, CASE WHEN old THEN 'deprecated_algorithm' END, CASE WHEN hardcoded THEN 'hardcoded_material' END, CASE WHEN weak THEN 'weak_random_source' END] IF x IS NOT NULL], ',') AS tags,
 least(0.99, greatest(0.5, (CASE WHEN ecb THEN 0.98 WHEN few THEN 0.85 ELSE 0.8 END)::DOUBLE * (CASE provider WHEN 'cryptography' THEN 0.95 WHEN 'python-stdlib' THEN 0.9 WHEN 'pycryptodome' THEN 0.85 WHEN 'bcrypt' THEN 0.95 WHEN 'nacl' THEN 0.95 WHEN 'paramiko' THEN 0.8 WHEN 'M2Crypto' THEN 0.7 ELSE CASE WHEN provider IS NULL THEN 0.7 ELSE 0.75 END END)::DOUBLE)) AS confidence FROM r2)"""
)
RULE = (
    FULL
    + f""", hits AS (SELECT m.id, r.rule_id, r.priority, r.actionable, r.seq, CASE r.rule_id WHEN 'AES_ECB_MODE' THEN 'AES is used with ECB mode, which reveals patterns in encrypted data' WHEN 'PBKDF2_LOW_ITERATIONS' THEN 'PBKDF2 configured with ' || m.iterations || ' iterations; minimum 100,000 recommended'
 WHEN 'RSA_SMALL_KEY' THEN 'RSA key size ' || m.key_bits || ' bits; minimum 2048 bits required' WHEN 'WEAK_PRNG' THEN 'Weak RNG ' || m.api || ' used for cryptographic operation; use os.urandom()' WHEN 'DEPRECATED_HASH' THEN m.algorithm || ' is cryptographically broken; use SHA-256 or SHA-512'
 WHEN 'ECB_MODE_OBJECT' THEN 'ECB mode object instantiated; ECB should not be used for data encryption' WHEN 'LEGACY_BLOCK_CIPHER' THEN m.algorithm || ' is deprecated; migrate to AES or ChaCha20' WHEN 'HMAC_SHA256_USAGE' THEN 'Rule HMAC_SHA256_USAGE matched: primitive=message_authentication'
 ELSE 'Rule ' || r.rule_id || CASE WHEN len(r.algorithms) > 0 THEN ' matched: algorithm_in=[''' || array_to_string(r.algorithms, ''', ''') || ''']' ELSE ' matched cryptographic asset' END END AS explanation
 FROM m JOIN {dims.RULES_SQL} ON (len(r.algorithms) = 0 OR list_contains(r.algorithms, m.algorithm)) AND (len(r.operations) = 0 OR list_contains(r.operations, m.primitive)) AND (len(r.apis) = 0 OR list_contains(r.apis, m.api)) AND (len(r.modes) = 0 OR coalesce(list_contains(r.modes, m.mode), false))
 AND (len(r.matched) = 0 OR list_contains(r.matched, m.algorithm)) AND (r.key_below IS NULL OR m.key_bits < r.key_below) AND (r.iterations_below IS NULL OR (m.iterations < r.iterations_below AND m.iterations <> 0)))"""
)
V1 = (
    FULL
    + f""", v AS (SELECT m.id, r.seq, r.rule_id, r.risk FROM m JOIN {dims.V1_SQL} ON (len(r.apis) = 0 OR list_contains(r.apis, m.api)) AND (len(r.algorithms) = 0 OR list_contains(r.algorithms, m.api_algorithm)) AND (len(r.contains) = 0 OR len([1 FOR x IN m.arguments IF len([1 FOR w IN r.contains IF contains(x, w)]) > 0]) > 0)
 AND (r.number_below IS NULL OR len([1 FOR x IN m.arguments IF coalesce(TRY_CAST(replace(trim(x), '_', '') AS BIGINT) < r.number_below, false)]) > 0) AND (r.text_literal IS NULL OR list_contains(m.literal_types, 'str')))"""
)
_ORDER = "['info', 'low', 'medium', 'high', 'critical']"



SQL = {
    "match_api": BASE + " SELECT id, rank, seq, api FROM hit",
    "match_api_first_wins": BASE + " SELECT id, api, algorithm, primitive, provider FROM m0",
    "unmatched_calls_anti": BASE + " SELECT name, count(*) AS n FROM c WHERE id NOT IN (SELECT id FROM hit) GROUP BY name",
    "normalized_algorithms": FULL + " SELECT id, api, algorithm, primitive, provider, mode, padding, key_size, operation, evidence FROM m",
    "summary_grouping_sets": RISK + ", p AS (SELECT risk, primitive, algorithm, coalesce(provider, 'unknown') AS provider, operation FROM r WHERE asset_class = 'primary_asset') SELECT risk, primitive, algorithm, provider, operation, count(*) AS n FROM p GROUP BY GROUPING SETS ((risk), (primitive), (algorithm), (provider), (operation), ())",
    "class_counts": FULL + " SELECT asset_class, primitive, primitive || CASE WHEN asset_class = 'primary_asset' THEN ' is a cryptographic operation' ELSE ' supports primary crypto analysis' END AS class_reason, count(*) AS n FROM m GROUP BY 1, 2, 3",
    "call_details": FULL + " SELECT id, mode, padding, digest, curve, key_size, iterations, operation FROM m",
    "argument_signals": SIGNALS + ' SELECT id, CAST(idx AS INTEGER) AS "index", role, semantic_value, is_literal, literal_origin, origin_kind, origin_expression, said_mode AS mode, said_padding AS padding, CASE WHEN n IN (64, 112, 128, 192, 2048, 3072, 4096) OR n BETWEEN 256 AND 8192 THEN n END AS key_size FROM s',
    "flow_sources": FLOW + f" SELECT id, key_source, data_source, iv_source, nonce_source, salt_source, randomness_source, sink_type, sink_id, hardcoded, array_to_string({_names('mask')}, ',') AS classes FROM flow",
    "risk_full": RISK + " SELECT id, risk, tags, round(confidence, 2) AS confidence FROM r",
    "max_risk_fold": RISK + f" SELECT root, file, arg_max(risk, list_position({_ORDER}, risk)) AS risk, count(*) AS assets FROM r GROUP BY 1, 2",
    "rule_match_v2": RULE + " SELECT id, rule_id, explanation FROM hits",
    "rule_match_v1": V1 + f" SELECT m.id, coalesce(string_agg(rule_id, ',' ORDER BY seq), '') AS rules, coalesce(arg_max(v.risk, list_position({_ORDER}, v.risk)), 'info') AS risk FROM m LEFT JOIN v ON v.id = m.id GROUP BY m.id",
    "summary_v1": V1 + " SELECT rule_id, risk, count(*) AS n FROM v GROUP BY 1, 2",
    "rule_priority_sort": RULE + " SELECT id, string_agg(rule_id, ',' ORDER BY priority DESC, seq) AS rules FROM hits GROUP BY id",
    "rule_group": RULE + " SELECT CASE WHEN priority >= 80 THEN 'critical' WHEN actionable THEN 'actionable' ELSE 'informational' END AS bucket, rule_id, count(*) AS n FROM hits GROUP BY 1, 2",
    "source_label_classify": FULL + f", a AS (SELECT unnest(args) AS argument FROM m) SELECT source, count(*) AS n FROM (SELECT unnest({_names('k')}) AS source FROM (SELECT {_mask('argument')} AS k FROM a)) GROUP BY 1",
    "sink_first_match": FULL + " SELECT primitive, CASE WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption', 'hash', 'message_authentication', 'key_derivation') THEN 'crypto_sink' WHEN primitive IN ('symmetric_key_generation', 'asymmetric_key_generation', 'random_generation') THEN 'key_material_sink' WHEN primitive = 'digital_signature' THEN 'signature_sink' WHEN primitive IN ('certificate_management', 'certificate_request', 'certificate_attribute', 'certificate_extension') THEN 'certificate_sink' END AS sink, count(*) AS n FROM m GROUP BY 1, 2",
    "argument_roles": SIGNALS + ' SELECT api, CAST(idx AS INTEGER) AS "index", role, count(*) AS n FROM s GROUP BY 1, 2, 3',
    "argument_origins": SIGNALS + " SELECT origin_kind, literal_origin, count(*) AS n, count(DISTINCT semantic_value) AS texts FROM s GROUP BY 1, 2",
    "first_three_args": FULL + " SELECT id, array_to_string(args[1:3], ' | ') AS args FROM m",
    "asset_id_hash": FULL + " SELECT id, 'crypto-' || substr(sha256(concat_ws('|', api, file, coalesce(CAST(line AS VARCHAR), 'None'), coalesce(function, ''), id)), 1, 16) AS asset_id, 'n_' || substr(sha256(concat_ws('|', file, coalesce(CAST(line AS VARCHAR), 'None'), coalesce(function, ''), api)), 1, 12) AS node_ref FROM m",
    "function_panel": RISK + " SELECT root, coalesce(function, 'module_level') AS function, count(*) AS crypto_calls, count(DISTINCT algorithm) AS algorithms, count(*) FILTER (risk IN ('high', 'critical')) AS high FROM r GROUP BY 1, 2",
    "provider_components": FULL + " SELECT root, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(*) AS assets FROM m WHERE asset_class = 'primary_asset' GROUP BY 1",
}

_CHAINS = """nn AS (SELECT DISTINCT root, id, coalesce(function, name) AS fn FROM nodes WHERE id IS NOT NULL AND name IS NOT NULL),
g AS (SELECT DISTINCT a.root, a.fn AS caller, b.fn AS callee FROM edges e JOIN nn a ON a.id = e.source JOIN nn b ON b.id = e.target AND b.root = a.root WHERE upper(trim(e.kind)) = 'CALLS' AND a.fn <> b.fn),
up AS (SELECT root, fn, [fn] AS path FROM (SELECT root, caller AS fn FROM g UNION SELECT root, callee FROM g)
 UNION ALL SELECT up.root, up.fn, list_append(up.path, g.caller) FROM up JOIN g ON g.root = up.root AND g.callee = up.path[-1] WHERE NOT list_contains(up.path, g.caller) AND len(up.path) < 24),
ch AS (SELECT root, fn, path FROM up QUALIFY row_number() OVER (PARTITION BY root, fn ORDER BY len(path) DESC, path) = 1),
x AS (SELECT m.*, lower(coalesce(m.function, '')) AS fun, lower(api) AS lapi, lower(concat_ws(' ', coalesce(m.function, ''), coalesce(file, ''), coalesce(array_to_string(ch.path, ' '), m.function, ''), api, algorithm, primitive)) AS around,
 primitive IN ('asymmetric_key_generation', 'symmetric_key_generation') AS made FROM m LEFT JOIN ch ON ch.root = m.root AND ch.fn = m.function)"""
_CERT = _any("around", "certificate cert x509 csr")
_SER = "primitive = 'key_serialization' OR contains(lapi, 'serialization.')"
_BUILD = "CASE WHEN contains(lapi, 'builder') THEN 'build_certificate' ELSE 'manage_certificate_lifecycle' END"
_REQ = "primitive IN ('certificate_request', 'certificate_attribute', 'certificate_extension')"
#: (condition, value, method, confidence, evidence), in order
_CONTEXT = [
    (_CERT, f"CASE WHEN {_any('around', 'generate builder self_signed csr')} THEN 'certificate_generation' ELSE 'certificate_management' END", "multi_signal_context", 0.92, "'Certificate/X.509 signal from file, function, API, or algorithm'"),
    (f"(made OR primitive = 'key_derivation') AND {_any('around', 'key derive kdf generate')}", "'key_management'", "primitive_and_context", 0.86, "'Key-management primitive plus key/derive/generate context'"),
    (_any("fun", "auth login password hash"), "'authentication_flow'", "function_name_pattern", 0.85, "'Function name contains authentication keyword'"),
    (_any("fun", "encrypt cipher encode"), "'data_protection'", "function_name_pattern", 0.9, "'Function name contains encryption keyword'"),
    (_any("fun", "sign verify signature"), "CASE WHEN contains(fun, 'verify') THEN 'signature_verification' ELSE 'signature_generation' END", "function_name_pattern", 0.9, "'Function name contains signature keyword'"),
    (_any("fun", "random generate seed nonce"), "'random_number_generation'", "function_name_pattern", 0.85, "'Function name contains RNG keyword'"),
    ("primitive IN ('symmetric_encryption', 'asymmetric_encryption', 'key_derivation', 'message_authentication', 'random_generation', 'hash', 'certificate_management')",
     "CASE primitive WHEN 'symmetric_encryption' THEN 'data_protection' WHEN 'asymmetric_encryption' THEN 'key_exchange' WHEN 'key_derivation' THEN 'key_management' WHEN 'message_authentication' THEN 'integrity_verification' WHEN 'random_generation' THEN 'random_material_generation' WHEN 'hash' THEN 'hashing' ELSE 'certificate_management' END",
     "primitive_classification", 0.7, "'Derived from primitive type: ' || primitive"),
    ("true", "'general_cryptographic_operation'", "fallback", 0.5, "'No specific pattern detected'"),
]
_INTENT = [
    ("primitive = 'certificate_management' OR contains(lapi, 'certificatebuilder')", _BUILD, "api_and_primitive", 0.92, "'X.509 certificate builder or certificate management primitive'"),
    (_REQ, "'manage_certificate_lifecycle'", "primitive_type", 0.86, "'Certificate lifecycle support primitive'"),
    (_SER, "'key_material_serialization'", "api_and_primitive", 0.9, "'Key or certificate serialization API'"),
    (f"made AND {_CERT}", "'create_key_material'", "primitive_and_certificate_context", 0.93, "'Key generation occurs in certificate-related context'"),
    ("algorithm IN ('PBKDF2', 'Scrypt', 'Argon2', 'bcrypt')", "'derive_password_key'", "algorithm_purpose", 0.95, "algorithm || ' is designed for password derivation'"),
    ("algorithm IN ('HKDF', 'KDF')", "'derive_key_material'", "algorithm_purpose", 0.9, "'General-purpose key derivation function'"),
    ("primitive = 'symmetric_encryption'", "'encrypt_data'", "primitive_type", 0.85, "'Symmetric encryption primitive'"),
    ("made", "'create_key_material'", "primitive_type", 0.9, "'Key generation primitive'"),
    (f"primitive = 'random_generation' AND {_any('lower(text)', 'salt iv')}", "'create_iv_or_salt'", "argument_analysis", 0.8, "'Random generation primitive; Arguments suggest salt/IV generation'"),
    ("primitive = 'random_generation'", "'create_random_material'", "primitive_type", 0.8, "'Random generation primitive'"),
    ("primitive = 'message_authentication'", "'verify_data_integrity'", "primitive_type", 0.85, "'Message authentication primitive (HMAC)'"),
    ("primitive = 'hash'", "'compute_hash_digest'", "primitive_type", 0.8, "'Hash function primitive'"),
    ("true", "'unspecified_cryptographic_operation'", "fallback", 0.5, "'Unable to determine specific intent'"),
]


def _cases(rows: list[tuple], at: int) -> str:
    value = lambda x: f"'{x}'" if at == 2 else f"{x}::DOUBLE" if at == 3 else x
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {value(r[at])}" for r in rows) + " END"


SQL["usage_explanations"] = (
    FULL.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", "
    + _CHAINS
    + f""" SELECT id, {_cases(_CONTEXT, 1)} AS context, {_cases(_CONTEXT, 2)} AS context_method, {_cases(_CONTEXT, 3)} AS context_confidence, {_cases(_INTENT, 1)} AS intent, {_cases(_INTENT, 2)} AS intent_method, {_cases(_INTENT, 3)} AS intent_confidence,
 {_cases(_CONTEXT, 4)} || '; ' || {_cases(_INTENT, 4)} AS evidence, CASE WHEN primitive = 'certificate_management' OR contains(lapi, 'certificatebuilder') THEN {_BUILD} WHEN {_REQ} THEN 'manage_certificate_lifecycle' WHEN {_SER} THEN 'key_material_serialization' WHEN made THEN 'create_key_material'
 WHEN lower(algorithm) IN ('pbkdf2', 'scrypt', 'argon2', 'bcrypt') THEN 'derive_password_key' WHEN contains(lower(algorithm), 'pbkdf') OR contains(lower(algorithm), 'kdf') OR primitive = 'key_derivation' THEN 'derive_key_material' WHEN primitive IN ('symmetric_encryption', 'authenticated_encryption', 'asymmetric_encryption') THEN 'encrypt_data'
 WHEN primitive = 'random_generation' THEN 'create_random_material' WHEN primitive = 'hash' THEN 'compute_hash_digest' WHEN primitive = 'message_authentication' THEN 'verify_integrity' ELSE 'general_cryptographic_operation' END AS stated FROM x"""
)
