"""Documents with everything that can be odd about them."""
import random

LONG = " ".join(f"w{n % 977}" for n in range(60_000))
# names that operators use inside are columns of the input too
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string,"
          " score string, features string, digest string, size string, _row string, label string")


def documents(spark, rows):
    """Rows of (doc_id, text[, source])."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, *["x"] * 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(extra=()):
    return [(1, "the quick brown fox jumps over the lazy dog and runs away", "a"),
            (1, "the quick brown fox jumps over the lazy dog and runs away", "a"),   # a repeated row
            (2, None, "a"), (3, "", None), (None, "no id here at all", None), (4, LONG, "b"),
            (5, " \t\n ", "b"), (6, "é漢字 ß 👍 ▁ x", "b"), *extra]


def by_id(rows, column):
    return sorted((r["doc_id"] is not None, r["doc_id"], r[column]) for r in rows)


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]
