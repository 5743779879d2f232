import random

import numpy as np

from siltstone.operators import draws


def test_states_ahead():
    rng = random.Random(7)
    key = np.array(rng.getstate()[1][:-1], np.uint32)
    for states in (1, 700):
        rng = random.Random(7)
        for _ in range(states * draws.WORDS):
            rng.getrandbits(32)
        got, want = draws.ahead(key, draws.steps(states * draws.WORDS)), np.array(rng.getstate()[1][:-1], np.uint32)
        assert (got[1:] == want[1:]).all() and got[0] >> 31 == want[0] >> 31  # of the first word only the top bit is state


def test_sums_over_lots_and_rounds(spark, monkeypatch):
    """Replicates that end in any lot, in pages of many or few, and words that were
    too few at first, against Python's generator."""
    monkeypatch.setattr(draws, "LEAST", 52)
    for n, replicates, slack in ((1, 40, 6.0), (1000, 900, 6.0), (4096, 300, -300.0), (150_000, 6, 6.0)):
        values = np.random.default_rng(n).integers(-1, 2, n).astype(np.int8)
        rng, plain = random.Random(5), values.tolist()
        want = [sum(plain[rng.randrange(n)] for _ in range(n)) for _ in range(replicates)]
        assert draws.drawn_sums(spark, values, 5, replicates, slack) == want
