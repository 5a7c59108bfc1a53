import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import idfiles, ordered
from tidemark.llm.idfiles import Encoder, pack, read_header, read_ids, read_range, unpack, write_ids
from tidemark.llm.queries import BYTE_BPE

ODD = [
    "a  b", "a   b", " a", "  a", "a ", "a  ", "", "a\n b", "a\n  b \n", "x<|endoftext|> y <|endoftext|>z", "it's 's  's",
    "é à ñ ß don't", "1 2 ½ ² ①", "　a 　 b", "日本 語 \x85 a\x1c b", "a\xa0 b \xa0c", "😀 😀a 😀", "foo.\nBar, baz!! --  q", "\x00 \x00a",
]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(file):
    path = BYTE_BPE.replace("byte_bpe_50k.json", file)
    plain = Tokenizer.from_file(path)
    encode = Encoder(open(path, encoding="utf-8").read())
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(ODD)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 33, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::97] = 2**32 - 1
    assert (unpack(pack(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(idfiles.BLOCK, 7, np.uint32)
    ids[::100] = 2**31
    assert sum(map(len, pack(ids))) < 150


def test_range_reads_only_its_blocks(tmp_path):
    ids = np.arange(10_000, dtype=np.uint32) * 3
    path = tmp_path / "x"
    path.write_bytes(idfiles.file_bytes([5, 6], [4000, 6000], ids))
    with path.open("rb") as f:
        head = read_header(f)
        assert (read_range(f, head, 2000, 2100) == ids[2000:2100]).all()
        assert f.tell() <= head.index[3]
        assert len(read_range(f, head, 9_999, 20_000)) == 1 and len(read_range(f, head, 5, 5)) == 0
    with pytest.raises(ValueError):
        read_header(__import__("io").BytesIO(b"x" * 40))


@pytest.mark.parametrize("small", [False, True])
def test_files_hold_all_documents_in_order(docs, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(ordered, "PART_BYTES", 500)
        monkeypatch.setattr(idfiles, "FILE_IDS", 100)
    rows = [(k * 31 % 211, ODD[k % len(ODD)] * (k % 7)) for k in range(150)]
    files = write_ids(docs(rows), BYTE_BPE, str(tmp_path), 2)
    got = sorted(
        tuple(r) for r in read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    )
    plain, start = Tokenizer.from_file(BYTE_BPE), 0
    for (i, text), row in zip(sorted(rows), got, strict=True):
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert files.count() > 1 if small else files.count() == 1


def test_awkward_rows(awkward, empty, tmp_path):
    rows = read_ids(write_ids(awkward, BYTE_BPE, str(tmp_path), 2)).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 4, 4, 5, 6, 7, 8]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert read_ids(write_ids(empty, BYTE_BPE, str(tmp_path), 2)).count() == 0
