"""What the learned patterns recover: a third of the values of a kind is written so that no format recognises it."""

import re
import zlib

import duckdb
import pytest

from cadenza.llm import pii

DATA = "/root/testdata/sf0.01/documents.parquet"
MARKS = {"secret": re.compile(r"""([A-Za-z_]{3,20}) ?[=:] ?(["'])([A-Za-z0-9+/_-]{16,}+)\2""")}


def hidden(value):
    return zlib.crc32(value.encode()) % 3 == 0


@pytest.fixture(scope="module")
def found(spark):
    """(text, spans found, values hidden) of all documents, secrets of hidden values assigned by '==', which the format doesn't know."""
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}'").fetchall()
    texts = {i: MARKS["secret"].sub(lambda m: f"{m[1]} == {m[2]}{m[3]}{m[2]}" if hidden(m[3]) else m[0], t) for i, t in rows}
    assert sum(t != texts[i] for i, t in rows) >= 3
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs, ["doc_id"]).collect()}
    return [(texts[i], [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)]) for i in texts]


def test_hidden_secrets_are_recovered_by_their_patterns(found):
    asked = re.compile(r"""[A-Za-z_]{3,20} == (["'])([A-Za-z0-9+/_-]{16,}+)\1""")
    there, caught = 0, 0
    for text, spans in found:
        for m in asked.finditer(text):
            if any(c.isdigit() for c in m[2]) and any(c.isalpha() for c in m[2]):
                there += 1
                caught += ("secret", *m.span(2)) in spans
    assert there >= 3 and caught / there >= 0.9, (caught, there)


def test_nothing_else_is_found_beyond_the_formats(found):
    beyond = [text[a:b] for text, spans in found for k, a, b in set(spans) - set(pii.seeds(text)) if not hidden(text[a:b])]
    assert beyond == []
