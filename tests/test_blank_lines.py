"""Empty texts and blank lines: the queries against their SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from granary import catalog

WORDS, SENTENCES = "word " * 400, "Other thing. " * 200
TEXTS = [
    "", "\n", "\n\n\n", "a", "\na", "a\n", "a\n\nb", "  a \n   \n b ", "one\r\ntwo.\r\n", "12 a\n3.4 b\nReference", f"\n{WORDS}", f"a\n{WORDS}\n\n{SENTENCES}\n\n", f"{SENTENCES}\n\n{WORDS}end.\ntail",
    f"\n\n{WORDS}x\n\n\n{WORDS}y\n\n\n\nz", "a\n" + "\n" * 20 + "b\n" * 20, f"a\nb\nc\n{SENTENCES}\n\n{SENTENCES}", f"a\nb\n\n\n{WORDS}", "\n".join(["line of words. And more!"] * 120), "\n\n".join(["line of words"] * 200), "cost $5\n\n$6",
    "ends wide\u3000\nand narrow\u00a0 \nor em\u2003\nor by a tab\t",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    texts = [t for t in TEXTS for _ in range(5)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["answer_pieces", "chunk_listing", "parent_child_strategy", "recursive_strategy", "sentence_strategy", "fixed_strategy", "long_documents", "structure_chunks"])
def test_blank_lines_against_sql(spark, odd, name):
    (columns, got), (expected_columns, expected) = compare(spark, odd, connect(odd), catalog.queries()[name], catalog.oracle_sql()[name])
    assert columns == expected_columns
    assert got == expected


def test_one_known_region(spark):
    from granary.operators import blocks as B
    from granary.operators import chunking as C

    docs = spark.createDataFrame([(1, "1 "), (2, "1 \n"), (3, "1 \na\n\nb"), (4, "1 \n\n" + "w" * 1600), (5, None), (6, f"目录\n{WORDS}")], "doc_id long, text string")
    blocks = B.from_every_line(docs, level=lambda k: F.when(k == 0, 1))
    got = {r["doc_id"]: (r["title_path"], r["chunk_type"], r["char_count"], r["body"]) for r in C.chunk_documents(blocks, region="body").collect()}
    # A title alone is no chunk; what comes out in one piece keeps its blank lines.
    assert got == {2: ("1 ", "body", 0, "1\n"), 3: ("1 ", "body", 2, "1 \na\n\n\n\nb\n"), 4: ("1 ", "body", 1600, "1 \n\n\n" + "w" * 1600 + "\n"), 6: ("目录", "body", 2000, f"目录\n{WORDS.rstrip()}\n")}


def test_whole_pieces():
    from granary.config import ChunkConfig
    from granary.operators import chunking as C
    from granary.operators import regions as R

    region = R.Region("single", "", 0, [C.paragraph("all of it")])
    held = lambda pieces: [(d.blocks[0]["text"], d.split, C.body(d)) for d in C.llm(region, ChunkConfig(), pieces, whole=True)]
    assert held(["one ", "", None, "\t"]) == [("one ", True, "\n\none\n"), ("", True, "\n\n\n"), ("\t", True, "\n\n\t\n")]
    assert held([""]) == [("", False, "\n\n")]
    assert held([]) == held(None) == [("all of it", False, "\nall of it\n")]
