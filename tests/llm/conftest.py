import random

import pytest


def prose(seed: int, n_docs: int, lengths=(0, 400)) -> list[tuple[int, str | None]]:
    """Documents over few words, with copies, shared passages, nulls, empty and repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeéioubcdfgßlmn") for _ in range(r.randint(1, 7))) for _ in range(120)]
    text = lambda n: r.choice(["", " "]) + " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "  "]) for _ in range(n))
    shared = [text(40) for _ in range(3)]
    out: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, "   \n"), (903, "a" * 300), (904, "a" * 200), (905, "x")]
    for i in range(n_docs):
        kind = r.random()
        if out and kind < 0.15:
            t = r.choice(out)[1]
        elif kind < 0.4:
            t = text(r.randint(5, 60)) + " " + r.choice(shared)[r.randint(0, 30) :] + " " + text(r.randint(0, 60))
        elif kind < 0.5 and (t := r.choice(out)[1]):
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = text(r.randint(*lengths))
        out.append((i, t))
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return prose(7, 150)


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """Documents with an extra column of a name that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in docs_rows], "doc_id long, text string, lang string, source string, n_chars long, chunk int").repartition(5)
