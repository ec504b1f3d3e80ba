import zlib

import numpy as np
import pytest
import zstandard

from quarrygrid.llm import token_frames as T
from quarrygrid.llm.common import tokenizer_path, work_dir
from quarrygrid.llm.tokenize import MemoEncoder, load

ODD = ["", " ", "  a  b ", "a\n b", "\n \n", "it's 12²3 don't  x y  z", "ΑΣ σ Σ", "é äb", "日本語 テスト 1２３", "<|endoftext|> a<|endoftext|>", "</w> a </w>", "x\x1cy \x1c z", "İ I ı ǅ", "a\u0085b c", "tab\t x \ty", "ﬁ ﬁ", "µ ß ª", "é e ́x", "a" * 5000, "x foo,bar baz's. x'. word.'s word*** über,. a-b c_d_ e' f'' don't. ªµº! z!!\n w|", "a word. a word, a word; word. word,"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_library(name, documents):
    texts = ODD + [r.text for r in documents.limit(60).collect()]
    own, library = MemoEncoder(tokenizer_path(name), 500), load(tokenizer_path(name))
    for k in range(0, len(texts), 7):
        for text, ids in zip(texts[k : k + 7], own.encode(texts[k : k + 7]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def expected(df):
    library, start, out = load(tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_same_as_library(documents):
    got = T.token_output(documents, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(documents)


def test_odd_rows(odd, none):
    got = T.token_output(odd, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = expected(odd)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in want)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id or 0 for r in got] == [d or 0 for d, *_ in want]
    assert T.token_output(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_file_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "x.zst")
    w = T.TokenFileWriter(path)
    docs = [(5, np.arange(1000, dtype=np.uint32)), (None, np.array([7], np.uint32)), (6, np.full(300, 9, np.uint32))]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    f = T.TokenFile(path)
    assert f.doc_ids == [5, None, 6] and f.find(6) == [2] and f.n_tokens.tolist() == [1000, 1, 300]
    for k, (_, ids) in enumerate(docs):
        assert f.read(k).tolist() == ids.tolist()
    f.close()
    # Any decoder reads the frames as one stream and skips the index and the table.
    with open(path, "rb") as raw:
        data = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(data, "<u4").tolist() == np.concatenate([x for _, x in docs]).tolist()
    broken = bytearray(open(path, "rb").read())
    broken[len(broken) - 9 - 12 * 4 + 8] ^= 1  # a checksum in the table
    open(path, "wb").write(broken)
    f = T.TokenFile(path)
    with pytest.raises(ValueError):
        f.read(0)
    assert f.read(1).tolist() == [7]


def test_random_access_over_a_folder(spark, documents):
    folder = work_dir(spark, "tokens")
    files = T.write_token_files(documents, folder, tokenizer_path("byte_bpe_50k.json")).collect()
    library = load(tokenizer_path("byte_bpe_50k.json"))
    f = T.TokenFile(f"{folder}/{files[0].file}")
    text = documents.where(f"doc_id = {f.doc_ids[3]}").first().text
    assert f.read(3).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
