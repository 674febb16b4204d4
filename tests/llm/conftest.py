import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, vertex string, bucket int, score string, _drop int, component string"


def _rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, copies, hot source."""
    r = random.Random(5)
    vocab = {"en": "the of and to in is that for it was on are with be by this thing wather singer stone".split(), "de": "der die und in den von zu das mit sich des auf nicht ein haus straße grün".split()}
    prose = lambda lang, n: " ".join(r.choice(vocab[lang]) + r.choice(["", "ab", "er", "ing", "on"]) for _ in range(n))
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        text = "\n".join(prose(lang, r.randint(8, 40)) for _ in range(r.randint(1, 6)))
        if i % 4 == 1:
            text += " idiot moron " + prose(lang, 5)
        rows.append([i, text, lang, "hot" if i % 3 == 0 else f"s{i % 5}"])
    rows.append([200, rows[3][1], "en", "s1"])  # copies, exact and near
    rows.append([201, rows[7][1] + " tail", "en", "s1"])
    rows.append([202, rows[7][1].replace("the", "The"), None, None])
    rows += [[203, None, "en", "s2"], [204, "", "de", None], [205, " \t\n ", "en", "s1"], [206, "one", "en", "s1"], [207, "one two", "en", "s9"]]
    rows.append([208, prose("en", 30_000), "en", "hot"])
    rows.append([209, "token = \"deadbeef0123\" AK" + "IA" + "ABCDEFGH12345678 é 0123456789abcdef0123456789abcdef", "en", "s3"])
    rows.append([None, prose("en", 60), "en", "s1"])
    rows.append(list(rows[9]))  # a repeated row
    rows.append([11, prose("de", 70), "de", "s4"])  # an id twice
    return [(*x, len(x[1] or ""), "clash", 1, "x", 2, None) for x in rows]


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def sf(spark, rows, tmp_path_factory):
    """A folder with documents and labels; the columns beyond the contract's have names that operators use themselves."""
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(x[0], int((x[0] or 0) % 7 != 0), int("idiot" in (x[1] or ""))) for x in rows if x[0] is not None and x[0] < 80]
    labels += [(5, None, None), (None, 1, 0), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
