import random

import pytest


@pytest.fixture
def words():
    """A seeded generator of invented texts."""
    rng = random.Random(11)
    voc = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "tu") for b in ("n", "r", "sa", "do", "x")]

    def make(n):
        return " ".join(rng.choice(voc) for _ in range(n))

    return make
