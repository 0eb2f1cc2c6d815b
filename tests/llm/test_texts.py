import random

import pandas as pd
import pytest

from sparkbom.llm import leakage, mixing, origin, secrets, spam_pages
from sparkbom.llm.alignment import best_overlap, words
from sparkbom.llm.layout import layout
from sparkbom.llm.page_text import list_share
from sparkbom.llm.secret_text import credentials

DOC = "doc_id long, text string, lang string, source string, n string"


def test_layout_rules():
    assert layout("py", "# Code generated by x. DO NOT EDIT.\nx = 1\n") == "generated"
    assert layout("py", "x = 'Code generated by x. DO NOT EDIT.'\ndef f():\n    return x\n") is None
    assert layout("js", "".join(f"a{i}=function(b){{return b+{i};}};" for i in range(60))) == "minified"
    assert layout("py", "data = [\n" + "1, 2, 3, 4, 5, 6,\n" * 30 + "]\n") == "data"
    assert layout("py", "import os\n\n\ndef f(a):\n    b = a + 1\n    return [b]\n\n\nT = [\n    1, 2,\n    3, 4,\n]\n") is None
    assert layout("py", "x = f('" + "long words " * 60 + "')\ny = 2\n") is None


def test_origins(spark, monkeypatch):
    up = "def g(a, b):\n    total = a * b + 17\n    for i in range(total):\n        print(i, a, b, 'value of the loop')\n    return total\n\n\nclass K:\n    def h(self, q):\n        return [q, q + 1, q + 2]\n" * 2
    own = "def mine(z):\n    return z.name.lower() if z else None\n" * 5
    copy = "def shared_by_two(x):\n    y = [x, x, x]\n    return {k: v for k, v in zip(y, y)}\n" * 5
    rows = [(1, "/r/a/", "src/x.py", own), (2, "/r/a", "vendor/lib/y.py", own + "#"), (3, "/r/b", "src/z.py", up.replace("17", "18")), (4, "/r/b", "vendor_portal/q.py", own + "# own\n"), (5, "/r/a", "p/c.py", copy), (6, "/r/b", "q/d.py", copy), (7, "/r/b", "e.py", None), (8, "/r/b", "f.py", ""), (1, "/r/a/", "src/x.py", own)]
    files = spark.createDataFrame(rows, "file_id long, root string, file string, content string")
    upstream = spark.createDataFrame([("lib", up)], "library string, content string")
    got = {r.file_id: (r.origin, r.reason) for r in origin.origins(files, upstream).collect()}
    assert got == {2: ("vendored", "folder"), 3: ("vendored", "upstream"), 5: ("vendored", "subtree"), 6: ("vendored", "subtree")}
    monkeypatch.setattr(origin, "UPSTREAM_CHARS", 0)
    assert {r.file_id: (r.origin, r.reason) for r in origin.origins(files, upstream).collect()} == got
    findings = spark.createDataFrame([("/r/a", "vendor/lib/y.py"), ("/r/a", "src/x.py")], "root string, file string")
    assert origin.handwritten(findings, origin.origins(files, upstream)).count() == 1
    assert origin.origins(files.limit(0), upstream.limit(0)).count() == 0


def test_trees_of_originals_parts_of_them_and_forks(spark):
    line = "def step_{0}(a, b):\n    return [a * {0}, b + {0}, 'value of {0}']\n"
    up = "".join(line.format(i) for i in range(40))
    word = "abcdefghij"
    own = lambda i: "import os\n\n\ndef NAME(z):\n    if z is None:\n        return os.sep\n    total = [q for q in z if q != 'NAME']\n    for q in total:\n        print(q, end='NAME')\n    return {'NAME': total}\n\n\nclass Own:\n    label = 'NAME'\n".replace("NAME", "own_" + "".join(word[int(c)] for c in str(i)))
    rows = [(1, "/r/a", "lib/widget-1.2/deep/x.py", own(1)), (2, "/r/a", "lib/widget-1.2/y.py", None), (3, "/r/widget", "widget/z.py", own(3)), (4, "/r/b", "part.py", "".join(line.format(i) for i in range(10))), (5, "/r/b", "exact.py", up)]
    rows += [(10 + i, f"/r/fork{k}", f"src/f{i}.py", own(100 + i)) for k in (1, 2) for i in range(k * 20 - 20, k * 20)][:20]
    rows += [(60 + i, "/r/fork2", f"src/f{i}.py", own(100 + i)) for i in range(20)]
    rows += [(90, "/r/c", "v/one.py", own(900)), (91, "/r/c", "v/two.py", own(901)), (92, "/r/d", "w/one.py", own(900)), (93, "/r/d", "w/two.py", own(901)), (94, "/r/d", "main.py", own(902)), (95, "/r/c", "main.py", own(903))]
    files = spark.createDataFrame(rows, "file_id long, root string, file string, content string")
    upstream = spark.createDataFrame([("widget", "1.0", "widget/core.py", up)], "library string, version string, path string, content string")
    got = {r.file_id: r.reason for r in origin.origins(files, upstream).collect()}
    assert got == {1: "tree", 2: "tree", 4: "upstream", 5: "subtree", 90: "subtree", 91: "subtree", 92: "subtree", 93: "subtree"}
    tree = origin.merkle(files)
    same = {(r.root, r.path): r.hash for r in tree.collect()}
    assert same["/r/c", "v"] == same["/r/d", "w"] and same["/r/c", "v"] != same["/r/a", "lib"]


SECRETS = {
    'password = "Hx9$kLm2Qw"': ["Hx9$kLm2Qw"], 'password = "changeme"': [], 'API_TOKEN = os.environ["X_TOKEN_12345678"]': [], 'h = {"Authorization": "Bearer abcDEF123456ghiJKL"}': ["abcDEF123456ghiJKL"],
    'url = "postgres://app:S3cr.t-word@host/db"': ["S3cr.t-word"], 'url = "postgres://app:${PASSWORD}@host/db"': [], 'PASSWORD_HINT = "at-least-12-characters"': [], 'c = AES.new(b"0123456789abcdeX", AES.MODE_ECB)': ["0123456789abcdeX"],
    'RELEASE_SHA256 = "2e698e69b5436b421b29d4bfd1f218f0938b72b1257de949878d30d9"': [], 'K = "-----BEGIN EC PRIVATE KEY-----\\nabcdefghijklmnopqrstuvwxyz\\n-----END EC PRIVATE KEY-----"': ["-----BEGIN EC PRIVATE KEY-----\\nabcdefghijklmnopqrstuvwxyz\\n-----END EC PRIVATE KEY-----"],
    '"auth_x": "svc-relay:Cursor.ferry2096",': ["Cursor.ferry2096"], "": [], 'P = "-----BEGIN PUBLIC KEY-----abc-----END PUBLIC KEY-----"': [],
}


@pytest.mark.parametrize("text", SECRETS)
def test_credentials(text):
    assert sorted(credentials(text)) == sorted(SECRETS[text])


def test_find_and_redact(spark):
    one = 'def f():\n    connect(password="Hx9$kLm2Qw")\n'
    rows = [(1, "/r/a", "a.py", one), (1, "/r/a", "a.py", one), (2, "/r/b", "b.py", "note = 'uses Hx9$kLm2Qw again'\n"), (3, "/r/b", "c.py", None), (4, "/r/b", "d.py", "")]
    rows += [(10 + i, f"/r/{i}", "e.py", 'token = "shared-Value-12"\n') for i in range(8)]
    files = spark.createDataFrame(rows, "file_id long, root string, file string, content string")
    found = secrets.find(files)
    assert {tuple(r) for r in found.collect()} == {("source_files", "1", "Hx9$kLm2Qw"), ("source_files", "2", "Hx9$kLm2Qw")}
    done = {r.item_id: r.text for r in secrets.redact(secrets.places(files, None, None), found).collect()}
    assert done["1"] == one.replace("Hx9$kLm2Qw", "X" * 10) and len(done) == 2
    assert secrets.find(files.limit(0)).count() == 0


def test_alignment():
    assert words("A<br/>b_c, `D`!\n_e_") == ["a", "b_c", "d", "e"]
    assert best_overlap([9, 1, 2, 3, 4, 5, 6, 0, 8, 9, 10, 11, 12, 9], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])[0] == 12
    assert best_overlap([], [1]) == (0, 0)


def test_filters_of_alignments_lose_nothing():
    import numpy as np

    from sparkbom.llm.alignment import common, may_overlap, window

    rng = random.Random(9)
    held = 0
    for _ in range(3000):
        b = [rng.randrange(40) for _ in range(rng.choice([20, 30, 60]))]
        a = list(b)
        for _ in range(rng.choice([0, 2, 4, 8, 16])):
            at = rng.randrange(len(a))
            a[at : at + rng.choice([0, 1, 1])] = [rng.randrange(40)] * rng.choice([0, 1])
        a = [rng.randrange(40) for _ in range(5)] + a
        spans = max(best_overlap(a, b)[0], window(a, b, 20, 2)[0]) >= 20
        held += spans
        assert may_overlap(np.array(a), np.array(b), 20) or not spans
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common(a, b) == table[-1][-1]
    assert held > 500
    vectors = np.random.default_rng(1).standard_normal((500, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    probes = vectors[:50] + 0.3 * np.random.default_rng(2).standard_normal((50, 8))
    probes /= np.linalg.norm(probes, axis=1, keepdims=True)
    close = {tuple(x) for x in np.argwhere(probes @ vectors.T >= 0.8)}
    open_ = {(i, int(r)) for c, limit, rows in leakage.clusters(vectors, 0.8) for i in range(50) if probes[i] @ c >= limit for r in rows}
    assert close <= open_ and len(open_) < 50 * 500


def test_blocks_of_items_and_paraphrases(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, "t", f"Answer briefly. {' '.join(rng.choices(vocabulary, k=60))}", "two words") for i in range(8)]
    docs = []
    for d in range(80):
        body = items[d % 8][2].split()[2:]
        part = body[10:40] if d % 2 else [w for k, w in enumerate(body) if k % 4 != 3]  # every fourth word is missing
        docs.append((d, " ".join(rng.choices(vocabulary, k=30) + part + (["Two", "words."] if d % 3 == 0 else [])), "en", "s", "x"))
    table, tests = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, task string, text string, answer string")
    one = {tuple(r) for r in leakage.leaks(table, tests, cosine=0.7).collect()}
    assert {(r[0], r[1]) for r in one if r[2] == "passage"} == {(d, d % 8) for d in range(1, 80, 2)}
    assert {r[0] for r in one if r[2] == "paraphrase"} and all(r[0] % 6 == 0 and r[5] for r in one if r[2] == "paraphrase")
    assert all(r[5] == (r[0] % 3 == 0) for r in one)
    monkeypatch.setattr(leakage, "ITEM_CHARS", 800)
    again = {tuple(r) for r in leakage.leaks(table, tests, cosine=0.7).collect()}
    assert {(r[0], r[1]) for r in again if r[2] == "passage"} == {(r[0], r[1]) for r in one if r[2] == "passage"}


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, "t", "Answer briefly. " + " ".join(rng.choices(vocabulary, k=80)), "a") for i in range(12)]
    docs, want = [], set()
    for d in range(150):
        text = rng.choices(vocabulary[:150], k=60)
        if d % 3 == 0:
            i = d % 12
            body = items[i][2].split()[2:]
            n = rng.choice([8, 12, 24, 40, 80])
            at = rng.randrange(0, len(body) - n + 1)
            part = body[at : at + n]
            if n >= 24:
                want.add((d, i))
                if n >= 40:
                    part[n // 2] = "changed"
            text[20:20] = [w.upper() + "," for w in part]
        docs.append((d, " ".join(text), "en", "s", "x"))
    docs += [(900, None, None, None, None), (901, "", "en", "s", "x"), (902, "Answer briefly.", "en", "s", "x")]
    table = spark.createDataFrame(docs, DOC)
    tests = spark.createDataFrame(items, "item_id long, task string, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(table, tests).collect()} == want
    assert leakage.leaks(table, tests.limit(0)).count() == 0 and leakage.leaks(table.limit(0), tests).count() == 0


def test_mixing_weights(spark):
    import math

    def shares(target, usable, capacity=None):
        rows = [(float(a), float(b), float(c), float(b)) for a, b, c in zip(target, usable, capacity or usable)]
        return spark.createDataFrame(rows, "target double, usable double, capacity double, natural double")

    a = mixing.exponent_for_entropy(shares([0, 0, 0], [0.7, 0.2, 0.1]), 1.0)
    raw = [x**a for x in (0.7, 0.2, 0.1)]
    assert abs(-sum(x / sum(raw) * math.log(x / sum(raw)) for x in raw) - 1.0) < 1e-6
    table = shares([0.5, 0.5], [10 / 1010, 1000 / 1010], [10.0, 1000.0])
    a = mixing.exponent_for_total(table, 500.0)
    raw = [0.5**a * (c / 1010) ** (1 - a) for c in (10, 1000)]
    assert 0 < a < 1 and 9.99 < raw[0] / sum(raw) * 500 <= 10.001
    assert mixing.exponent_for_total(shares([0.5, 0.5], [0.5, 0.5], [1000.0, 1000.0]), 500.0) == 1.0
    a = mixing.exponent_within(table, 0.01)
    raw = [0.5**a * (c / 1010) ** (1 - a) for c in (10, 1000)]
    assert 0 < a < 1 and abs(abs(raw[0] / sum(raw) - 0.5) - 0.01) < 1e-6


def test_mix_reaches_shares_and_respects_limits(spark):
    docs = [(i, "some words of text " * (1 + i % 5), "en", ["A ", "a", "b", None][i % 4], "x") for i in range(400)] + [(990, None, "en", "a", "x"), (991, "", "en", "b", "x")]
    targets = spark.createDataFrame([("a", 0.3, 1), ("B", 0.6, 3), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, plan, sizes = mixing.mix(spark.createDataFrame(docs, DOC), targets)
    rows = used.toPandas()
    got = (rows["tokens"] * rows["uses"]).groupby(rows["source"]).sum()
    assert abs(got["b"] / got.sum() - 0.6 / 0.9) < 0.02 and rows["doc_id"].is_unique
    assert rows[rows["source"] == "b"]["uses"].max() <= 3 and rows[rows["source"] == "a"]["uses"].max() <= 1
    report = mixing.report(used, plan, sizes).toPandas()
    assert report[report["source"].isna()]["left_out"].tolist() == [100] and report["documents"].sum() == 401
    report = report.set_index("source")
    assert report.loc["missing", "used_tokens"] == 0 and abs(report["reached_share"].sum() - 1) < 1e-9
    assert mixing.mix(spark.createDataFrame([], DOC), targets)[0].count() == 0
    assert isinstance(plan.toPandas(), pd.DataFrame)


def test_spam(spark):
    prose = "The {0} reads a value from the store and it is checked by the team before we send it. If the {1} is missing, the job waits for an hour and then stops with an error. We keep the {0} for the old clients that still ask for it."
    names = ["reader", "broker", "ledger", "packet", "meter", "vault", "relay", "badge"]
    rng = random.Random(1)
    docs = [(i, " ".join(prose.format(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(1, 5))), "en", "s", "x") for i in range(200)]
    spam = {500: "\n".join(f"[{rng.choice(names)} {i}](https://x.example/{i})" for i in range(40)), 501: "Best vpn service deals, best vpn service prices. Our vpn service is the vpn service for every vpn service buyer. Get vpn service, try vpn service, share vpn service. " * 4, 502: " | ".join(f"{rng.choice(names)} tools" for _ in range(60)), 503: "#" + " #".join(rng.choice(names) for _ in range(80))}
    good = {600: docs[0][1] + "\nSee also:\n- https://x.example/1\n- https://x.example/2"}
    rows = docs + [(k, v, "en", "s", "x") for k, v in (spam | good).items()] + [(700, None, "en", "s", "x"), (701, "", None, "s", "x"), (702, "!!", "en", "s", "x")]
    table = spark.createDataFrame(rows, DOC)
    assert {r.doc_id for r in spam_pages.spam_pages(table).collect()} == set(spam)
    assert spam_pages.spam_pages(table.limit(0)).count() == 0
    assert list_share("", []) == 0.0
    assert list_share("The reader is here. It is not the vault.", [frozenset(["the", "is", "it", "not"])]) == 0.0


WHOLE = {
    'String apiKey =\n    "Hx9$kLm2Qw77";\n': "Hx9$kLm2Qw77", 'c = AES.new(\n    b"0123456789abcdeX",\n    AES.MODE_ECB)\n': "0123456789abcdeX", 'password = "s3c!"': "s3c!", 'passphrase = "correct horse battery staple"': "correct horse battery staple",
    'cfg.set("db.password", "Hx9$kLm2Qw")': "Hx9$kLm2Qw", "x = '<password>Hx9$kLm2Qw</password>'": "Hx9$kLm2Qw", "y = 1\n# api_key: Zk8Lm2Qw9Xy4Tn7Bv3\n": "Zk8Lm2Qw9Xy4Tn7Bv3", "see('ghp_Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4zAb7d')": "ghp_Ab3dEf6hIj9kLm2nOp5qRs8tUv1wXy4zAb7d",
    f'password = "{"aB3$xK9-" * 700}"': "aB3$xK9-" * 700, "x = [1]" + ", 'a#b'" * 3000 + ", 'Zk8Lm2Qw9Xy4Tn7Bv3'  # the token of the gateway": "Zk8Lm2Qw9Xy4Tn7Bv3",
    'secret = "/Kx9wQ2mT7vLp4Rz8Yb"': "/Kx9wQ2mT7vLp4Rz8Yb", 'password = "purple-monkey-dishwasher"': "purple-monkey-dishwasher", 'c = connect("db:1", "app", "Hx9$kLm2Qw")': "Hx9$kLm2Qw",
}


@pytest.mark.parametrize("text", WHOLE)
def test_credentials_in_whole_texts(spark, text):
    files = spark.createDataFrame([(1, "/r/a", "a.py", text), (2, "/r/b", "b.py", "İ private key\n" + text)], "file_id long, root string, file string, content string")
    assert {tuple(r) for r in secrets.find(files).collect()} == {("source_files", "1", WHOLE[text]), ("source_files", "2", WHOLE[text])}
    assert [r.secret for r in secrets.find(files.where("file_id = 1")).collect()] == [WHOLE[text]]


@pytest.mark.parametrize("text", ['class Token:\n    """Keeps one local barge per gateway."""', 'def f() -> Token:\n    """Keeps one thing."""', 'token_kind = "access-token"', 'password = "Please enter it."', 'secret = "/etc/app/secret.key"', 'token = "=="'])
def test_no_credentials(text):
    assert credentials(text) == {}


def test_every_literal_is_indexed(spark):
    rows = [("/r/a", "x = 'plain one'\ny = \"plain one\" + `other`\npassword = 'Hx9$kLm2Qw'\n"), ("/r/b", "z = 'plain one'\nHx = 'Hx9$kLm2Qw' + 'abc'\n")]
    index = secrets.literal_index(spark.createDataFrame(rows, "root string, text string")).collect()
    assert sorted((r.secret or "", r.owners, r.places, r.strength) for r in index) == [("", 1, 1, 0), ("", 2, 3, 0), ("Hx9$kLm2Qw", 2, 2, 2)]


def test_weak_values_need_their_name_and_keys_any_owners(spark, monkeypatch):
    key = "-----BEGIN PRIVATE KEY-----\nabcdefghijklmnopqrstuvwxyz\n-----END PRIVATE KEY-----"
    rows = [(i, f"/r/{i}", "a.py", f'k = """{key}"""') for i in range(30)] + [(50, "/r/x", "a.py", 'password = "s3c!"\n'), (51, "/r/y", "b.py", "note = 's3c!'\n")]
    rows += [(60, "/r/x", "c.py", 'password = "Hx9$kLm2Qw:more"\n'), (61, "/r/y", "d.py", 'secret = "Hx9$kLm2Qw"\n')]
    files = spark.createDataFrame(rows, "file_id long, root string, file string, content string")
    one = {tuple(r)[1:] for r in secrets.find(files).collect()}
    assert one == {(str(i), key) for i in range(30)} | {("50", "s3c!"), ("60", "Hx9$kLm2Qw:more"), ("61", "Hx9$kLm2Qw")}
    monkeypatch.setattr(secrets, "BLOCK", 1)
    assert {tuple(r)[1:] for r in secrets.find(files).collect()} == one
    index = spark.createDataFrame([(1, "shared-Value-12", 8, 8, 2)], "key long, secret string, owners long, places long, strength int")
    assert secrets.confirmed(index, 40).count() == 0 and secrets.confirmed(index, 100).count() == 1


def test_leaks_with_an_edit_near_an_end_and_short_items(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, "t", " ".join(rng.choices(vocabulary, k=80)), "a") for i in range(12)] + [(50, "t", " ".join(rng.choices(vocabulary, k=8)), "a"), (51, "t", " ".join(rng.choices(vocabulary, k=16)), "a")]
    docs, want = [], set()
    for d in range(144):
        body = items[d % 12][2].split()
        part = body[20:40]
        at, kind = [1, 2, 3, 16, 17, 18][d // 12 % 6], d // 72
        part[at : at + 1] = [["changed"], [part[at], "put", "in"][: 1 + (d % 3 > 0)]][kind]
        text = rng.choices(vocabulary, k=60)
        text[20:20] = part
        docs.append((d, " ".join(text), "en", "s", "x"))
        want.add((d, d % 12))
    for d, item, drop in ((900, 12, None), (901, 13, None), (902, 13, 0), (903, 13, 9), (904, 12, 3)):
        part = items[item][2].split()
        if drop is not None:
            part[drop] = "changed"
        docs.append((d, " ".join(["other"] * 33 + part + ["other"] * 31), "en", "s", "x"))
        if d != 904:
            want.add((d, items[item][0]))
    found = [(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, task string, text string, answer string")).collect()]
    assert set(found) == want and len(found) == len(want)


def test_more_languages_than_one_pass_compares(spark, monkeypatch):
    rng = random.Random(2)
    rows, n = [], 0
    for lang in "abcde":
        words = [f"{lang}{i}" for i in range(300)]
        for _ in range(30):
            rows.append((n, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=60)), lang, "s", "x"))
            n += 1
    rows.append((n, "a1 a2 b3", "rare", "s", "x"))
    table = spark.createDataFrame(rows, DOC)
    columns = ["doc_id", "model", "words", "head", "size"]
    one = {tuple(r) for r in spam_pages.curves(table).select(columns).collect()}
    assert {r[1] for r in one} == set("abcde") and len(one) == n + 1
    monkeypatch.setattr(spam_pages, "BATCH", 2)
    assert {tuple(r) for r in spam_pages.curves(table).select(columns).collect()} == one


def test_copied_and_lone_spam(spark):
    prose = "The {0} reads a value from the store and it is checked by the team before we send it. If the {1} is missing, the job waits for an hour and then stops with an error. We keep the {0} for the old clients that still ask for it."
    names = ["reader", "broker", "ledger", "packet", "meter", "vault", "relay", "badge"]
    rng = random.Random(1)
    docs = [(i, " ".join(prose.format(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(1, 5))), "en", "s", "x") for i in range(200)]
    spam = "\n".join(f"[{rng.choice(names)} {i}](https://x.example/{i})" for i in range(30))
    long = "\n".join(f"[{rng.choice(names)} {i}](https://x.example/{i})" for i in range(3000))
    rows = docs + [(1000 + i, spam, "en", "s", "x") for i in range(300)] + [(2000, long, "en", "s", "x"), (2001, " ".join(d[1] for d in docs[:90]), "en", "s", "x")]
    assert {r.doc_id for r in spam_pages.spam_pages(spark.createDataFrame(rows, DOC)).collect()} == {*range(1000, 1300), 2000}


def test_every_place_is_redacted(spark, tmp_path):
    from sparkbom.llm.queries_secrets import p5_redacted

    properties = "struct<parameters: array<string>, code: string, arguments: array<string>, keywords: map<string, string>, resolved_name: string, callee: string, literal_arguments: array<struct<py_type: string, repr: string>>>"
    call = (["a"], "f(password='Hx9$kLm2Qw', pin='s3c!')", ["x", "'Hx9$kLm2Qw'"], {"password": "'s3c!'"}, "f", "f", [("str", "'Hx9$kLm2Qw'")])
    spark.createDataFrame([(1, "/r/a", "a.py", "note = 'uses Hx9$kLm2Qw'\n"), (2, "/r/a", "b.py", "x = 1\n")], "file_id long, root string, file string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([("n1", "/r/a", call), ("n2", "/r/a", None)], f"id string, root string, properties {properties}").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(7, "/r/b", "f", ["k", "'Hx9$kLm2Qw'"]), (8, "/r/b", "f", None)], "finding_id long, root string, api_name string, arguments array<string>").write.parquet(f"{tmp_path}/findings.parquet")
    got = {(r.place, r.item_id, r.field): r.text for r in p5_redacted(spark, str(tmp_path)).collect()}
    x, q = "X" * 10, "properties."
    assert got == {
        ("source_files", "1", "content"): f"note = 'uses {x}'\n", ("nodes", "n1", q + "code"): f"f(password='{x}', pin='XXXX')", ("nodes", "n1", q + "arguments[1]"): f"'{x}'", ("nodes", "n1", q + "keywords.password"): "'XXXX'",
        ("nodes", "n1", q + "literal_arguments[0].repr"): f"'{x}'", ("findings", "7", "arguments[1]"): f"'{x}'",
    }
