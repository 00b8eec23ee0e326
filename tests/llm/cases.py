"""Documents that every operator must take: nulls, empties, long texts, repeats, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, id string, n int, token string, __salt int, c long, fam long, kind int"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 5, n: int = 30) -> list[tuple]:
    """(id, text) rows: plain, near and exact copies, repeated rows, null ids and texts, blanks, one long text."""
    rng = random.Random(seed)
    out: list[tuple] = []
    for i in range(n):
        out.append((i, " ".join(words(rng, rng.choice([3, 20, 60, 120])))))
    base = words(rng, 120, 10_000)
    for i in range(25):  # a group of near copies around one text, at many distances
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        out.append((100 + i, " ".join(copy)))
    chain = words(rng, 100, 10_000)
    for i in range(12):  # each close to the next, the ends far apart
        chain = [f"y{i}", *chain[:-1]]
        out.append((200 + i, " ".join(chain)))
    out += [(300, out[3][1]), (301, out[3][1].upper()), (302, None), (303, ""), (304, " \t\n"), (305, "one"), (306, "ONE"), (307, " é"), (308, "é")]
    out += [(None, "a row without an id and a text of its own"), (None, out[4][1]), (None, None), out[5], out[5]]
    out.append((400, "\n".join(" ".join(words(rng, 12)) for _ in range(3000))))
    rng.shuffle(out)
    return out


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else ("en", "de")[k % 2], None if k % 5 == 0 else f"s{k % 3}", 1, 2, "x", 3, "t", 4, 5, 6, 7) for k, (i, t) in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
