"""Queries over documents of which some have no text, against their SQL."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests import compare

CORPUS = (
    "jsonl_records",
    "common_words",
    "kept_statistics",
    "role_labels",
    "similarity_map",
    "similarity_map_absent_neighbours",
    "similarity_map_absent_query",
    "universal_ranks",
    "universal_report",
)
INDEX = ("search_texts", "search_files_l2", "search_files_cosine", "search_page_l2", "search_page_cosine")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    texts = [" ".join(word() for _ in range(rng.choice([3, 40, 200]))) for _ in range(40)]
    for at, blank in ((0, None), (7, ""), (8, " \n\t"), (21, "　"), (39, None)):
        texts[at] = blank
    base = tmp_path_factory.mktemp("blank")
    ids = list(range(len(texts)))
    documents = {"doc_id": ids, "text": texts, "source": [f"s{i % 3}" for i in ids]}
    asked = [f"{word()} {word()} {word()}" for _ in range(3)] + [None, " \n"]
    items = {"item_id": list(range(5)), "text": asked}
    for name, columns in (("documents", documents), ("benchmark", items), ("labels", {"doc_id": ids[::2]})):
        pq.write_table(pa.table(columns), base / f"{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", CORPUS + INDEX)
def test_documents_without_text_are_left_out(spark, tables, name):
    got = compare.spark_rows(entry.queries()[name](spark, tables))
    assert got == compare.sql_rows(compare.connect(tables), entry.oracle_sql()[name])


def test_every_line_has_its_id(spark, tables):
    """Also those without text, as only records that are read whole need an embedding."""
    assert entry.queries()["jsonl_ids"](spark, tables).count() == 40
