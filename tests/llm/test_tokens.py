"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from swaplens.llm import token_counts, token_output, tokenizing, word_encoding

from .helpers import awkward, empty, table


@pytest.fixture(scope="module")
def path():
    return token_output.default_tokenizer()


@pytest.fixture(scope="module")
def plain(path):
    return Tokenizer.from_file(path)


def expected_file(rows, plain):
    out, start = [], 0
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file_round_trip(spark, tiny, path, plain):
    docs = table(spark, tiny, "documents")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.round_trip(docs, path).collect())
    assert got == expected_file(sorted((r.doc_id, r.text) for r in docs.collect()), plain)


def test_token_file_of_awkward_rows(spark, path, plain):
    docs = awkward(spark)
    got = token_output.round_trip(docs, path, chunk=2000, overlap=64).collect()
    one = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    assert one == {(d, n, c) for d, _, n, c in expected_file([(r.doc_id, r.text) for r in docs.collect()], plain)}
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    assert token_output.round_trip(empty(spark), path).count() == 0


def test_only_wanted_columns_are_read(spark, tiny, path, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_output.write_tokens(table(spark, tiny, "documents"), out, path)
    plan = spark.read.parquet(out).groupBy("part").sum("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_counts(spark, tiny, path, plain):
    docs = table(spark, tiny, "documents")
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(plain.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
    assert sorted(map(tuple, token_counts.count_tokens(docs, path).collect())) == want
    assert sorted(map(tuple, token_counts.count_tokens(docs, path, chunk=300, overlap=16).collect())) == want


def test_counts_of_awkward_rows(spark, path, plain):
    docs = awkward(spark)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()), key=repr)
    got = token_counts.count_tokens(docs, path, chunk=1000, overlap=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert token_counts.count_tokens(empty(spark), path).count() == 0


ODD = ["a", "B", "é", "漢", "😀", " ", "  ", "\n", "\t", "'s", "1", "23", "...", "<|endoftext|>", " ", "\r\n", ",", ".", "-", "x" * 40]


def test_splicing_is_the_whole_encoding(plain):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choices(ODD, k=rng.randrange(1, 400)))
        got = tokenizing.encode_spliced(plain, text, rng.choice([16, 40, 100]), rng.choice([1, 4, 16]))
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_text_without_any_boundary(plain):
    text = "y" * 5000
    assert tokenizing.encode_spliced(plain, text, 100, 8).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [600_000, 300, 20])
def test_encoding_by_words_is_the_whole_encoding(path, plain, kept, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_encoding, "KEPT", kept)  # few are forgotten again and again
    rng = random.Random(2)
    encoder = word_encoding.WordEncoder(path)
    for _ in range(60):
        texts = ["".join(rng.choices(ODD, k=rng.randrange(0, 60))) for _ in range(20)]
        texts += [" ".join("".join(rng.choices(["a", "Bc", "é", "漢", "1", ",", ".", "'s", "-", "!"], k=rng.randrange(1, 6))) for _ in range(30)) for _ in range(20)]
        ids, n = encoder.encode(pa.array(texts), 1 << 15, 256)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_each_distinct_word_is_looked_up_once(path, plain):
    import pyarrow as pa

    class Counted(dict):
        lookups = 0

        def __contains__(self, word):
            Counted.lookups += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            Counted.lookups += 1
            return super().__getitem__(word)

        def get(self, word, other=None):
            Counted.lookups += 1
            return super().get(word, other)

    encoder = word_encoding.WordEncoder(path)
    encoder.place = Counted()
    for words in (["one", "two", "three"], ["two", "four", "one", "five"]):  # all new; known and new ones
        text = " ".join(words)
        ids, n = encoder.encode(pa.array([text]), 1 << 15, 256)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
    # a first word is one of its own, as it has no space before it
    assert Counted.lookups == 3 + 4


def test_the_file_has_the_form_that_it_promises(spark, path, tmp_path):
    """Row groups of a bounded size in order of ids, dictionary pages, page indexes; chosen documents are read alone."""
    from pathlib import Path

    import pyarrow.parquet as pq

    docs = spark.range(0, 3000).selectExpr("id AS doc_id", "repeat(concat('w', id % 50, ' '), 40) AS text").repartition(4)
    out = str(tmp_path / "form")
    token_output.write_tokens(docs, out, path)
    bounds = []
    for file in Path(out).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            assert group.total_byte_size <= token_output.ROW_GROUP * 2
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert ids.has_dictionary_page and any("DICTIONARY" in e for e in ids.encodings)
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            bounds.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    bounds.sort()
    assert len(bounds) >= 4 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    got = token_output.read_tokens(spark, out, [7, 2999, 5000])
    assert [r.doc_id for r in got.collect()] == [7, 2999]
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in scan.replace("in (", "In(").replace("In (", "In(") or "PushedFilters: [In" in scan
    whole = spark.read.parquet(out).orderBy("part", "ordinal").collect()
    assert [r.doc_id for r in whole] == list(range(3000)) and {r.ordinal for r in whole if r.part == whole[0].part} == set(range(sum(r.part == whole[0].part for r in whole)))
