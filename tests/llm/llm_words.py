import random


def words(seed: int, n: int, stems=("tha", "ing", "er", "on", "the", "re", "st", "ou", "ha")) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))
