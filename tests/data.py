"""Small seeded wells for the tests."""

import random

import pandas as pd

CODES = (30000, 65000, 65030, 80000)
SCHEMA = ("WELL string, SOURCE_ROW long, DEPT double, GR double, RDEP double, RMED double, DTC double, RHOB double, "
          "TRUE_CODE int, A int, B int, C int")


def rows(sizes=(("w1", 97), ("w2", 23), ("w3", 1), ("w4", 211)), seed=3):
    rng = random.Random(seed)
    out = []
    for well, n in sizes:
        depth, code = 1000.0, rng.choice(CODES)
        for i in range(n):
            depth += 0.152 if rng.random() > 0.03 else 9.5
            code = rng.choice(CODES) if rng.random() < 0.1 else code
            true = None if rng.random() < 0.1 else code
            value = lambda lo, hi, p=0.15: None if rng.random() < p else round(rng.uniform(lo, hi), 2)
            out.append((well, i, depth, value(-5, 100), value(-1, 60), value(-1, 60), value(-10, 150), value(1.8, 2.9),
                        true, code if rng.random() < 0.8 else rng.choice(CODES), code if rng.random() < 0.7 else rng.choice(CODES),
                        code if rng.random() < 0.9 else rng.choice(CODES)))
    return out


def frame(data=None):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(data or rows(), columns=names)
