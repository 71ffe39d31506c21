import hashlib
import math
import random
import re
from statistics import NormalDist

from vellumine.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", '"', "'", " ", " ", ":", "=", "AKIA", "ABCD1234EFGH5678", "abcdef0123456789", "deadbeef" * 5, "x.y=z-", "é", "\n", "\U0001f511"]
    rows += [(10_000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)] + [(20_000, None), (20_001, ""), (None, "token=abcdefgh"), (1, rows[1][1])]
    out = secrets.report(secrets.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int"))).collect()
    want = sorted((str(i), hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), *(sum(x.startswith(k) for x in brute(t)) for k, *_ in PATTERNS)) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in out) == want
    assert all(set(brute(t)) <= set(s.split(",") if (s := next(r.spans for r in out if r.doc_id == i)) else []) for i, t in rows[:50])


def test_random_tokens_are_told_from_names(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 60))) for _ in range(60)]
    name = [f"getUserAccountSettingsManager{i % 9}InternalConfigurationHandler" for i in range(60)] + ["Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1Aa1"] * 9
    rows = [(i, f"a {k} b") for i, k in enumerate(key)] + [(1000 + i, f"call {k} now") for i, k in enumerate(name)]
    out = {r.doc_id: r.n_random for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(out[i] for i in range(60)) >= 50
    assert sum(n for i, n in out.items() if i >= 1000) == 0


def test_phi_and_no_rows(spark):
    from statistics import NormalDist

    zs = [-9.0, -6.5, -3.0, -1.0, 0.0, 0.5, 2.0, 7.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(secrets.phi(__import__("pyspark.sql.functions").sql.functions.col("z")).alias("p")).collect()]
    assert all(abs(p - NormalDist().cdf(z)) < 1e-6 for p, z in zip(got, zs))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(secrets.scan(empty)).count() == 0


def test_values_after_equals_signs_and_tokens_without_digits(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    make = lambda chars, n=40: "".join(rng.choice(chars) for _ in range(n))
    assigned = [how % make(letters + "0123456789") for how in ("DB_AUTH=%s", "export SIGNING_KEY=%s ", "see http://host/p?sig=%s&x=1", "a=%s==") for _ in range(10)]
    plain = ["x " + make(letters) + " y" for _ in range(20)]
    names = ["call getUserAccountSettingsManagerInternalConfigurationHandler now", "in ApplicationContextInitializationExceptionHandlerFactory"] * 10
    rows = list(enumerate(assigned + plain + names))
    out = {r.doc_id: r for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(out[i].n_random for i in range(40)) >= 32 and sum(out[i].n_random for i in range(40, 60)) >= 14
    assert sum(out[i].n_random for i in range(60, 80)) == 0
    first = next(out[i] for i in range(10) if out[i].n_random)
    assert first.spans == "random:8:48"


def brute_battery(token):
    body = token.rstrip("=")
    kind = next(((k, a, ic) for k, (pattern, a, ic) in secrets.ENCODINGS.items() if re.search(pattern, token)), None)
    codes, phi = list(map(ord, body)), NormalDist().cdf
    n, mean, middle = len(codes), sum(codes) / len(codes), sorted(codes)[len(codes) // 2]
    high = [c >= middle for c in codes]
    mu = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = (mu - 1) * (mu - 2) / (n - 1)
    var, serial = sum((c - mean) ** 2 for c in codes), sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:]))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    p_runs = 2 * phi(-abs(runs - mu) / math.sqrt(spread)) if spread > 0 else 0.0
    p_serial = 2 * phi(-abs((serial / var + 1 / n) * math.sqrt(n))) if var > 0 else 0.0
    if kind is None:
        return None, n, None, p_runs, p_serial
    size, skew = kind[1], kind[1] * kind[2] - 1
    chi = size / n * sum(codes.count(c) ** 2 for c in set(codes)) - n
    return kind[0], n, phi((chi - (size - 1 + n * skew)) / math.sqrt(2 * (size - 1 + 2 * n * skew))), p_runs, p_serial


def test_battery_against_brute_force(spark):
    rng = random.Random(8)
    sets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "aB3", "abcABC012+/", "ABCDEFGHabcdefgh0123456789_-", "aaaaaab"]
    tokens = ["".join(rng.choice(c) for _ in range(rng.randrange(20, 90))) + rng.choice(["", "", "=", "=="]) for c in sets for _ in range(30)] + ["a" * 30, "AB" * 20, "abc" * 9 + "==", "Ab0" * 700]
    got = {r.token: r for r in secrets.battery(spark.createDataFrame([(t,) for t in set(tokens)], "token string")).collect()}
    for t, r in got.items():
        want = brute_battery(t)
        assert (r.encoding, r.n) == want[:2], t
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-5) for a, b in zip((r.p, r.p_runs, r.p_serial), want[2:])), (t, r, want)
    assert len({r.encoding for r in got.values()}) == len(secrets.ENCODINGS) + 1


def test_step_up_control_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([20, 31, 40, 70, 300]), 10 ** -rng.uniform(0, 12) if rng.random() < 0.4 else rng.random()) for _ in range(3000)] + [(20, 0.0), (40, 1.0)]
    got = secrets.thresholds(spark.createDataFrame(rows, "n int, p double"))
    edge = lambda p: min(400, math.floor(-math.log2(max(p, 1e-40)) * secrets.BINS))
    want = {}
    for c in {int(math.log2(n)) for n, _ in rows}:
        bins = sorted((edge(p) for n, p in rows if int(math.log2(n)) == c), reverse=True)
        passed = [b for k, b in enumerate(bins, 1) if 2 ** (-b / secrets.BINS) <= secrets.FDR * k / len(bins)]
        if passed:
            want[c] = min(passed)
    assert got == want and len(want) >= 3


def test_many_matches_in_one_text(spark):
    rng = random.Random(10)
    text = " ".join(rng.choice(["token=abcdefgh%d", "AKIA%dABCDEFGHIJKL", "secret: 'k%dpqrstuvw'", "deadbeef%dcafe0123456789abcdef0123456789abcdef"]) % rng.randrange(10, 99) for _ in range(30_000))
    out = secrets.report(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = brute(text)
    assert out.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and out.n_assign + out.n_access + out.n_hex == len(want) > 25_000
