import pytest

from sparkbom.operators import documents as D
from sparkbom.operators import explain as E
from sparkbom.operators import graph as G
from sparkbom.operators import match as M
from sparkbom.operators import signals as S
from sparkbom.sources import python_source as P

FILES = {
    "aes.py": "from Crypto.Cipher import AES\n\n\ndef encrypt(key, payload):\n    c = AES.new(key, AES.MODE_ECB)\n    return c.encrypt(payload)\n",
    "digest.py": "import hashlib\nimport hmac\n\n\ndef sums(key, message):\n    a = hashlib.md5(message).digest()\n    b = hashlib.sha256(message).digest()\n    return hmac.new(key, message, hashlib.sha_256).digest() + a + b\n",
    "box.py": "from cryptography.fernet import Fernet\n\n\ndef box(note):\n    key = Fernet.generate_key()\n    return Fernet(key).encrypt(note)\n",
    "rsa.py": "from Crypto.PublicKey import RSA\nfrom Crypto.Cipher import PKCS1_OAEP\n\n\ndef wrap(message):\n    key = RSA.generate(2048)\n    return PKCS1_OAEP.new(key).encrypt(message)\n",
    "kdf.py": "import hashlib\nimport secrets\n\n\ndef stretch(password):\n    salt = secrets.token_bytes(16)\n    return hashlib.pbkdf2_hmac('sha256', password, salt, 100000)\n",
    "cbc.py": "import os\nfrom cryptography.hazmat.primitives.ciphers import Cipher, algorithms, modes\n\n\nclass Box:\n    def seal(self, data):\n        iv = os.urandom(16)\n        return Cipher(algorithms.AES(self.key), modes.CBC(iv))\n\n    def loose(self, data):\n        return Cipher(algorithms.TripleDES(b'0123'), modes.CBC(b'0123456789abcdef'))\n\n    def flow(self, data, nonce):\n        return Cipher(algorithms.ChaCha20(self.key, nonce), mode=None)\n",
}
# (file, api, occurrence) -> algorithm, mode, key size, risk, confidence, tags, rules, key, data, iv, nonce, salt, randomness
WANT = {
    ("aes.py", "AES.new"): ("AES", "ECB", "unknown", "critical", 0.833, ["ecb_mode_detected"], ["AES_ECB_MODE"], "function_parameter", "external_input", None, None, None, None),
    ("digest.py", "hashlib.md5"): ("MD5", None, None, "high", 0.72, ["deprecated_algorithm"], ["DEPRECATED_HASH"], None, "function_parameter", None, None, None, None),
    ("digest.py", "hashlib.sha256"): ("SHA-256", None, None, "low", 0.72, [], [], None, "function_parameter", None, None, None, None),
    ("digest.py", "hmac.new"): ("HMAC-SHA-256", None, "unknown", "low", 0.72, [], [], "function_parameter", "function_parameter", None, None, None, None),
    ("box.py", "Fernet.generate_key"): ("Fernet", None, None, "low", 0.76, [], ["FERNET_RECOMMENDED"], "generated_random", None, None, None, None, "generated_random"),
    ("box.py", "Fernet"): ("Fernet", "unknown", "unknown", "low", 0.76, [], ["FERNET_RECOMMENDED"], "return_value", "external_input", "unknown", None, None, None),
    ("rsa.py", "RSA.generate"): ("RSA", None, "2048", "low", 0.68, [], [], "generated_random", None, None, None, None, "generated_random"),
    ("rsa.py", "PKCS1_OAEP.new"): ("RSA-OAEP", "unknown", "unknown", "low", 0.68, [], [], "return_value", "external_input", None, None, None, None),
    ("kdf.py", "secrets.token_bytes"): ("CSPRNG", None, None, "low", 0.72, [], ["CSPRNG_BEST_PRACTICE"], None, None, None, None, None, "generated_random"),
    ("kdf.py", "hashlib.pbkdf2_hmac"): ("PBKDF2", None, "unknown", "medium", 0.72, ["hardcoded_material"], [], "derived_from_kdf", "hardcoded_constant", None, None, "generated_random", "generated_random"),
}


@pytest.fixture(scope="module")
def graph(spark):
    rows = P.parse(spark.createDataFrame([("/r", k, v) for k, v in FILES.items()], "root string, file string, content string"))
    nodes = P.nodes(rows)
    edges = P.containment(rows).unionByName(G.resolve_calls(nodes).selectExpr("source", "target", "'CALLS' as kind"))
    return nodes.cache(), edges.cache()


def test_assets_by_file(graph):
    nodes, edges = graph
    a = S.assets(M.matched(nodes), nodes, edges)
    rules = {}
    for r in M.rule_matches(a).orderBy("seq").collect():
        rules.setdefault(r.id, []).append(r.rule_id)
    got = {(r.file, r.api): (r.algorithm, r["mode"], r.key_size, r.risk, round(r.confidence, 3), r.tags, rules.get(r.id, []), r.key_source, r.data_source, r.iv_source, r.nonce_source, r.salt_source, r.randomness_source) for r in a.where("file <> 'cbc.py'").collect()}
    assert got == WANT


def test_wrapped_ciphers(graph):
    nodes, edges = graph
    a = S.assets(M.matched(nodes), nodes, edges).where("file = 'cbc.py' and api = 'Cipher'")
    got = {r.function: (r.algorithm, r["mode"], r.risk, r.tags, r.key_source, r.iv_source, r.nonce_source, r.evidence) for r in a.collect()}
    inner = "Resolved inner Cipher algorithm from arguments: "
    assert got == {
        "cbc.seal": ("AES", "CBC", "low", ["cbc_requires_authentication_review"], "object_property", "generated_random", None, [inner + "AES"]),
        "cbc.loose": ("3DES", "CBC", "high", ["cbc_requires_authentication_review", "iv_source_unresolved", "deprecated_algorithm"], "unknown", "unknown", None, [inner + "3DES"]),
        "cbc.flow": ("ChaCha20", "stream", "low", [], "object_property", None, "function_parameter", [inner + "ChaCha20", "ChaCha20 treated as stream cipher semantics"]),
    }


@pytest.mark.parametrize(
    "text, literal",
    [("'a'", True), ('"a" + "b"', True), ("b'x\\x00'", True), ("-1.5e3", True), ("0x1F", True), ("None", True), ("[1, 'a', (None, {})]", True), ("", False), ("key", False), ("f'a'", False), ("key1", False), ("x[0]", False), ("f(1)", False), ("1 - 2", False), ("NoneType", False), ("'" + "a\\n" * 9000 + "'", True), ("[" + "1, " * 9000 + "x]", False), ("[" + "1, " * 9000 + "2]", True)],
)
def test_literals(spark, text, literal):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(S.is_literal(F.col("t"))).first()[0] is literal


def test_nested_arguments(spark):
    from pyspark.sql import functions as F

    rows = [("algorithms.ChaCha20(key[1:2], f(a, (b, 'x,)')))",), ("algorithms.AES(key=k)",), ("other(key)",), (None,), ("algorithms.AES(" + "(" * 3 + "k" + ")" * 3 + ")",), ("modes.CBC(b'" + "x" * 20000 + "')",)]
    d = spark.createDataFrame(rows, "value string")
    one = lambda call, place: [r[0] for r in d.select(S._argument_of_call(F.col("value"), call, place)).collect()]
    assert one(r"algorithms\.(?:aes|chacha20)", 0) == ["key[1:2]", None, None, None, "(((k)))", None]
    assert one(r"algorithms\.chacha20", 1)[0] == "f(a, (b, 'x,)'))" and len(one(r"modes\.cbc", 0)[5]) == 20003


def test_explanations(graph):
    nodes, edges = graph
    pairs = G.call_graph(nodes, edges)
    m = E.explained(D.full_assets(nodes, edges)).where("file = 'kdf.py' and api = 'hashlib.pbkdf2_hmac'").first()
    assert m.usage_context.value == "key_management" and m.intent.asDict()["value"] == "derive_password_key" and m.usage_intent == "derive_password_key"
    assert m.data_flow.value.input_sources[-2:] == ["generated_random", "hardcoded_constant"] or "hardcoded_constant" in m.data_flow.value.input_sources
    assert m.derivation_path.value.call_depth == 1 and pairs.columns == ["root", "caller", "callee"]


def test_empty_and_null_calls(spark, graph):
    nodes, edges = graph
    none = nodes.limit(0)
    assert S.assets(M.matched(none), none, edges.limit(0)).count() == 0 and D.bills(D.full_assets(none, edges.limit(0))).count() == 0
    bare = nodes.where("kind = 'call'").selectExpr("cast(null as string) as root", "id", "kind", "name", "cast(null as string) as file", "cast(null as int) as line", "cast(null as string) as function", "named_struct('resolved_name', properties.resolved_name, 'callee', cast(null as string), 'arguments', cast(null as array<string>), 'keywords', cast(null as map<string,string>), 'literal_arguments', cast(null as array<struct<py_type:string,repr:string>>), 'code', cast(null as string), 'parameters', cast(null as array<string>)) as properties")
    out = S.assets(M.matched(bare), bare, edges).collect()
    assert len(out) == M.matched(nodes).count() and {r.tags == [] for r in out} | {True} == {True, False}
