import random

import pytest

DOCS = "doc_id long, text string, fp string, row int, ranges string, starts string, lang string, source string, n_chars long"


def _sentence(rng, n, words="the of and to in is on by at with tion ing ed er est".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "a", "o"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(11)
    passage = _sentence(rng, 60)
    lines = "\n".join(_sentence(rng, 6) for _ in range(4))
    rows = []
    for i in range(40):
        rows.append((i, _sentence(rng, rng.choice([1, 2, 5, 25, 80])).title()))
    rows += [(100, ""), (101, None), (None, passage), (None, None), (102, " \t\n "), (103, "word"), (104, "Word"),
             (105, passage), (106, "x  " + passage.replace(" ", "\t") + " y"), (107, passage + " " + passage),
             (108, lines + "\n\nend"), (109, "start\n" + lines), (110, lines.replace("\n", "\n \n")), (111, "a " * 400),
             (112, _sentence(rng, 30000)), (113, "日本語 テキスト　é ñ"), (113, "日本語 テキスト　é ñ"),
             (114, passage + " one"), (114, passage + " three"), (115, passage.upper()), (116, "x" * 5000)]
    base = _sentence(rng, 200).split()
    for i in range(30):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = f"edit{i}"
        rows.append((200 + i, " ".join(near)))
    rng.shuffle(rows)
    return [(i, t, "f", 1, None, "s", None if k % 7 == 0 else "en", None, None if t is None else len(t))
            for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
