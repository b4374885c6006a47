import hashlib
import random
import re
import string

from tests.llm.fixtures import documents, empty
from wirelens.llm import secrets

PATTERNS = (
    ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def brute(text):
    text = text or ""
    found = [(m.start(), k, m.end()) for k, (_, rx, group, least) in enumerate(PATTERNS) for m in rx.finditer(text) if len(m[group]) >= least]
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def planted(seed=1):
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    made = []
    for k in range(80):
        n = rng.randrange(8, 44)
        made.append(rng.choice([
            f'Password: "{some(string.ascii_letters + string.digits, n)}"', f"API_KEY={some(string.hexdigits, n)}", f"apikey = {some('0123456789abcdef', n)} é", f"x AKIA{some(string.ascii_uppercase + string.digits, n)} y",
            some("0123456789abcdef", n), f"😀 toKen'  :  {some('ab.=-_', n)}", "nothing here", f"toKen = {'a' * 20}", f"secret={'a' * 11} passwd==={'b' * 13}",
        ]))
    return [*made, "\n".join(made), None, ""]


def test_base_spans_equal_brute_force(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(df)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in ("assign", "access", "hex"):
            assert got[i][f"n_{kind}"] == sum(x.startswith(kind) for x in base)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("novel")] == base


def test_novel_strings_need_a_sensitive_place_and_must_not_repeat():
    novel = "Zq8rT2vLx9Kd4Wm7Bn3C"
    kinds = lambda text: [k for _, k, _, _ in secrets.spans(text)]
    assert kinds(f"auth {novel}") == kinds(f"auth={novel}==") == ["novel"]
    assert kinds(f"plain words {novel}") == kinds(f"auth\n{novel}") == kinds(f"auth{' ' * 60}{novel}") == []
    assert kinds(f"auth {novel} then {novel}") == ["novel", "novel"]  # a copy nearby makes a secret no less new
    assert [n for _, k, _, n in secrets.spans(f"token = abcdefghijkl1 auth {novel}")][0] is None
    assert secrets.novelty("secret_key_session_id_2024", "set the ", " here") < 0.85 < 0.9 < secrets.novelty(novel, "set the ", " here")


def test_candidates_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["key", "auth ", "x" * 14, "AKIA" + "A" * 18, "\n", " ", "a" * 20, "token=" + "b" * 12, "-" * 5, "=", "é"]) for _ in range(14))
        found = secrets.base_spans(text)
        expected = []
        for m in secrets.CANDIDATE.finditer(text):
            ends = [w.end() for w in secrets.SENSITIVE.finditer(text) if w.start() <= m.start()]
            clear = not any(a < m.end() and m.start() < b for a, _, b in found)
            if ends and m.start() - ends[-1] <= secrets.BEFORE and clear and "\n" not in text[ends[-1] : m.start()]:
                expected.append(m.span())
        assert list(secrets.candidates(text, found)) == expected


def test_planted_secrets_of_many_shapes_are_found_and_identifiers_are_not(spark):
    """Recall by shape, and false finds among identifiers that other texts of the corpus hold too."""
    rng = random.Random(0)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b62 = string.ascii_letters + string.digits
    shapes = [(b62, 20, ""), (b62, 40, ""), (b62, 128, ""), (b62 + "+/", 64, ""), ("0123456789ABCDEF", 32, ""), (string.digits, 24, ""), (string.ascii_lowercase, 24, ""), (string.ascii_letters, 32, ""), (b62, 24, "sk_live_"), (b62, 36, "ghp_")]
    parts = "user session value access manager config index default client server request response handler factory count name type load save update delete find create build".split()
    known = ["_".join(rng.sample(parts, 3)) for _ in range(200)]
    code = ['const AUTH_FIELD = "{}";\nexport function connect(settings) {{ return client.open(settings.host, 30); }}\n', '    "bearer": "{}",\n    "timeout": 30,\n    "host": "db1.example.com"\n']
    rows, kind = [], {}
    for k, (letters, n, lead) in enumerate(shapes):
        for _ in range(40):
            kind[len(rows)] = k
            rows.append(rng.choice(code).format(lead + some(letters, n)))
    for name in known:
        kind[len(rows)] = -1
        rows.append(rng.choice(code).format(name))
    rows += [f"def {a}({b}): return {a} + {b}" for a in known for b in rng.sample(known, 3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: len(r.spans) for r in secrets.find_secrets(df).collect()}  # digits alone are found as hex
    for k in range(len(shapes)):
        own = [got[i] > 0 for i in kind if kind[i] == k]
        assert sum(own) / len(own) >= 0.9, shapes[k]
    assert sum(got[i] > 0 for i in kind if kind[i] == -1) / len(known) <= 0.05
    assert sum(got[i] for i in range(len(kind), len(rows))) == 0


def test_secrets_that_stand_twice_are_found():
    rng = random.Random(1)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b62 = string.ascii_letters + string.digits
    for letters, n in ((b62, 20), (b62, 40), (b62, 128), (b62 + "+/", 64), ("0123456789ABCDEF", 32), (string.ascii_lowercase, 24), (string.ascii_letters, 32)):
        made = [some(letters, n) for _ in range(60)]
        found = [sum(k == "novel" for _, k, _, _ in secrets.spans(f'auth: "{x}"\nbackup auth: "{x}"\ntimeout: 30\n')) == 2 for x in made]
        assert sum(found) / len(found) >= 0.9, (letters, n)


def test_the_cache_of_shapes_is_bounded():
    rng = random.Random(2)
    for k in range(800):
        secrets.spans("auth " + "".join(rng.choice("aZ9") for _ in range(14 + k % 9)))
    assert secrets._standins.cache_info().currsize <= 512


def test_time_grows_with_the_text_alone():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        secrets.spans("key " * n + "token = abcdefghijkl1 " * (n // 100))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_whole_texts_and_odd_rows(spark):
    far = "word " * 200_000 + "token = abcdefghijkl1"
    assert [s[1] for s in secrets.spans(far)] == ["assign"]
    df = documents(spark)
    out = secrets.find_secrets(df)
    assert out.count() == df.count() and out.columns == ["doc_id", "spans"]
    assert secrets.find_secrets(empty(spark)).count() == 0
