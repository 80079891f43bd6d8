"""Documents with the awkward cases: nulls, empty and long texts, ties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, s string, size int, score double, rank int, text_hash long, drop string, cls long"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["tion", "Anhe", "wher", "é", "ß", "thinter", "of", "a", "12", "don't", "x.y", "naïve", "日本"]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        out.append("\n".join(lines))
    long = " ".join(f"w{i % 977}" for i in range(9000))
    near = out[0].split(" ")
    near[len(near) // 2] = "changed"
    huge = "\n".join(" ".join(f"{rng.choice(words)}{rng.randrange(5000)}" for _ in range(40)) for _ in range(8000))  # 2.5 MB
    common = "Common  Line"
    out += [None, "", " ", "\n", "\n\n", "one", "two words", out[0], out[0], " ".join(near), long, long + " tail", "a" * 700, "ab" * 300, huge]
    out += [f"{common}\nbody {i} {out[i]}" for i in range(12)] + ["  common  line \t"] * 2
    return out


def rows(seed=3):
    data = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, i, "x", 1, 0.5, 1, 2, "d", 3) for i, t in enumerate(texts(seed))]
    data += [data[5], data[5]]  # repeated rows
    return data


def frame(spark, seed=3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
