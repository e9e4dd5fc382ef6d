"""Words of the tests' texts."""

WORDS = "the of and river stone light quick brown under over tree house winter summer letter number silver garden window market".split()
SPARE = "straße garçon niño über école mañana".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.4) for _ in range(n))
