"""Made-up words for small corpora."""

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "ne", "sa", "mo", "li") for b in ("ran", "tel", "dis", "mok", "ver", "pil", "sun", "gor")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
