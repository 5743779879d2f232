import hashlib
import random

import numpy as np

from siltstone.llm import fingerprints as P
from siltstone.llm.common import Texts


def _set(t):
    w = t.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_unbiased():
    random.seed(3)
    error = []
    for _ in range(150):
        a = [f"w{random.randint(0, 10**6)}" for _ in range(300)]
        b = list(a)
        cut = random.randint(0, 300)
        b[cut:] = [f"v{random.randint(0, 10**6)}" for _ in range(300 - cut)]
        x, y = " ".join(a), " ".join(b)
        m = P.fingerprints(Texts.of_list([x.encode(), y.encode()]))
        error.append(P.likeness(*m) - len(_set(x) & _set(y)) / len(_set(x) | _set(y)))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.04


def test_small_texts():
    m = P.fingerprints(Texts.of_list([b"", b" \n", b"one", b"one two", b"one", b"x" * 9000]))
    assert m[0] == m[1] == b"" and m[2] == m[4] != m[3]
    assert P.likeness(m[0], m[1]) == 1 and P.likeness(m[0], m[2]) == 0 and P.likeness(m[2], m[4]) == 1


def test_small_sets_are_unbiased():
    """Texts of few shingles: densification repeats values in many bins."""
    random.seed(8)
    error = []
    for _ in range(300):
        n, kept = random.randint(1, 9), random.random()
        words = [f"w{random.randint(0, 10**6)}" for _ in range(n + 4)]
        other = [w if random.random() < kept ** 0.2 else "v" + w for w in words]
        x, y = " ".join(words), " ".join(other)
        m = P.fingerprints(Texts.of_list([x.encode(), y.encode()]))
        error.append((P.likeness(*m), len(_set(x) & _set(y)) / len(_set(x) | _set(y))))
    gap = np.array([a - b for a, b in error])
    apart = np.array([a for a, b in error if b == 0])
    assert len(apart) > 30 and np.sqrt((apart**2).mean()) < 0.06
    assert abs(gap.mean()) < 0.03


def _plain_mark(text):
    """A fingerprint value by value, without arrays."""
    shingles = _set(text)
    if not shingles:
        return ""
    data = Texts.of_list([text.encode()])
    hashes, _ = P.shingle_hashes(P.Words(data), 5)
    bins = {}
    for h in map(int, hashes):
        bins[h >> 55] = min(bins.get(h >> 55, 2**64), h & (2**55 - 1))
    filled = dict(bins)
    mix = lambda x: int(P.mix64(np.array([x % 2**64], np.uint64))[0])
    for place in range(512):
        attempt = 1
        while place not in filled:
            donor = mix(place * 0x9E3779B1 + (attempt << 32)) >> 55
            if donor in bins:
                filled[place] = bins[donor]
            attempt += 1
    low = [mix(filled[i] ^ mix(i)) & 15 for i in range(512)]
    return bytes(low[i] | low[i + 1] << 4 for i in range(0, 512, 2)).hex()


def test_fingerprints_against_plain_python():
    texts = ["", "one", "a b c d e f g", " ".join(f"w{i}" for i in range(700)), "x " * 3000]
    assert [m.hex() for m in P.fingerprints(Texts.of_list([t.encode() for t in texts]))] == [_plain_mark(t) for t in texts]
    a, b = _plain_mark(texts[2]), _plain_mark("a b c d e f z")
    equal = sum(x == y for x, y in zip(a, b)) / 512
    assert P.likeness(bytes.fromhex(a), bytes.fromhex(b)) == max(0.0, (equal - 1 / 16) / (15 / 16))


def test_neighbours(spark):
    random.seed(5)
    rows = [(i, " ".join(random.choice("abcdefgh") * 3 for _ in range(random.randint(0, 60)))) for i in range(0, 300, 3)]
    rows += [(None, "null id"), (7, None), (9, "again"), (9, "again é中"), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for k, (i, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in P.compare_neighbours(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert P.compare_neighbours(df.limit(0)).count() == 0
    alone = P.compare_neighbours(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0
