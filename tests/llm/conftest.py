import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          # names that operators use themselves
          "shard int, slot string, size string, kept string, model string, words string, hood string, task string, "
          "line int, template string, queue string, part string, place string, ids string, d2 string, key string")
EXTRA = (None,) * 16


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n invented words, with a line break now and then."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        word = "".join(pick.choice(("ta", "ri", "no", "le", "su", "mo", "ke")) for _ in range(pick.randint(1, 3)))
        out.append(f"{word}{pick.randrange(vocabulary) % 7 * 'a'}{'.' if pick.random() < 0.1 else ''}")
    return "".join(w + ("\n" if pick.random() < 0.04 else " ") for w in out).strip()


def edited(text: str, seed: int, edits: int) -> str:
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"edit{pick.randrange(10 ** 6)}"
    return " ".join(words)


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with clashing extra columns."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    base, long = prose(1, 120), prose(2, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "One two.", "en", None),
        (5, base, "en", "a"), (6, base, "en", "b"), (7, edited(base, 1, 1), "en", "a"), (7, edited(base, 1, 1), "en", "a"),
        (None, base, None, None), (None, None, None, None), (8, long, "de", "b"), (9, long + " end", "de", "b"),
        (10, "naïve Ünïcode 中文 🙂 end  two blanks \r\n next", "fr", "a"), (11, prose(3, 60), "en", "a"), (11, prose(4, 60), "en", "a"),
        (12, "<|endoftext|> and 'more' it's", "en", "a"),
    ]


@pytest.fixture
def edge_docs(spark, edge_rows):
    return frame(spark, edge_rows)
