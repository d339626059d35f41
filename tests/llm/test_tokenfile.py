import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_specs import SCHEMA, SF, make_docs
from tokenizers import Tokenizer

from lodeweave.llm import queries, shared, text, tokenfile, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def spec(rows):
    """(doc_id, start, n_tokens, ids_crc32) in order of (doc_id, size, checksum), nulls first."""
    ids = [(r[0], [*PLAIN.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    made = sorted(((d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids))
    out, at = [], 0
    for known, d, n, crc in made:
        out.append((d if known else None, at, n, crc))
        at += n
    return sorted(out, key=repr)


def test_files_round_trip(spark, monkeypatch):
    rows = make_docs(3) + [(5, "<|endoftext|> and more\r\n", "en", 0.1, "", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in tokenfile.through_files(spark, docs, PATH).collect()), key=repr) == spec(rows)
    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(tokenfile, "FILE_BLOCKS", 2)
    folder = f"{shared.shared_dir(spark)}/round"
    manifest, ranked = tokenfile.write(docs, PATH, folder)
    manifest = manifest.collect()
    assert sum(r.n_docs for r in manifest) == len(rows) and len({r.file for r in manifest}) > 2
    back = tokenfile.read(spark.createDataFrame(manifest), ranked, folder).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in back), key=repr) == spec(rows)
    known = {r[0]: r[1] for r in rows if r[0] is not None}
    once = [r for r in back if sum(q[0] == r.doc_id for q in rows) == 1 and r.doc_id is not None]
    assert all(np.frombuffer(r.ids, "<u4")[:-1].tolist() == PLAIN.encode(known[r.doc_id] or "", add_special_tokens=False).ids for r in once)


def test_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert tokenfile.through_files(spark, docs, PATH).count() == 0


def test_query_on_the_table(spark):
    out = queries.op12_token_files(spark, SF)
    assert [(c, t) for c, t in out.dtypes] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == spec(rows)


def test_units_equal_whole_texts():
    rng = random.Random(1)
    alphabet = [*"abcdeéXY'ß€漢1234 .,!<|>-", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　", "<|endoftext|>", "'s", "  ", "\x00"]
    texts = ["".join(rng.choice(alphabet if rng.random() < 0.3 else alphabet[:20] + [" "] * 6 + ["\n", "\r", "\x0b"]) for _ in range(rng.randrange(0, 60))) for _ in range(3000)] + ["", "w" * 400 + " " + "w" * 401]
    # Every character of the basic plane between words: no row that is read by units may differ.
    texts += ["".join(f"a{chr(c)} b{chr(c)}{chr(c + 1)}c {chr(c)}d" for c in range(lo, lo + 8)) for lo in range(0x20, 0xD7F0, 8)]
    encoder = tokenfile.Encoder(PATH)
    for _ in range(2):  # the second time from memory
        ids, ends = encoder.group(*text.column_bytes(pa.array(texts)))
        assert all(ids[a:b].tolist() == e.ids for a, b, e in zip(ends[:-1], ends[1:], PLAIN.encode_batch(texts, add_special_tokens=False), strict=True))


def test_variable_length_coding():
    rng = np.random.default_rng(0)
    numbers = np.concatenate([rng.integers(0, 2**k, 500) for k in (3, 8, 9, 16, 17, 24, 25, 32)] + [np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1])]).astype(np.uint32)
    rng.shuffle(numbers)
    sizes = np.array([0, 1, 2, 3, 4, 5, 0, len(numbers) - 15])
    control, data, controls, lengths = tokenfile.packed(numbers, sizes)
    assert controls.tolist() == [-(-n // 4) for n in sizes.tolist()] and int(lengths.sum()) == len(data)
    assert (tokenfile.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), sizes) == numbers).all()


def test_strings_compares_bytes(monkeypatch):
    words = [b"qybaxhunaeaaaaaa", b"yjtpmmxxnzerfmpt", b"", b"a", b"abcdefgh", b"abcdefghi", b"x" * 300, b"x" * 301, b"\0", b"\0\0"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for same_hash in (False, True):
        if same_hash:  # the worst of all hashes
            monkeypatch.setattr(text, "hashes", lambda buf, start, end, table=text.SAME, key=0: np.full(len(start), 7, np.uint64))
        strings, learned = text.Strings(), []
        learn = lambda a, b, to=learned: to.extend(zip(a.tolist(), b.tolist(), strict=True))
        first = strings.numbers(buf, starts, ends, learn)
        assert sorted(first.tolist()) == list(range(len(words))) and len(learned) == len(words)
        assert (strings.numbers(buf, starts[::-1], ends[::-1], learn) == first[::-1]).all() and len(learned) == len(words)
        assert [words.index(buf[a:b].tobytes()) for a, b in learned] == np.argsort(first).tolist()


def test_cut():
    data = b"one  two\r\n three\xc2\xa0x" + b" " + b"\nlast\r"
    buf, offs = np.frombuffer(data, np.uint8), np.array([0, 8, len(data)])
    starts, ends, rows = units.cut(buf, offs)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == [b"one", b"  two", b"\r\n three\xc2\xa0x", b" \nlast", b"\r"] and rows.tolist() == [0, 2, 5]
    assert [data[a:b] for a, b in zip(*units.cut(buf, offs, b"\r")[:2], strict=True)][-1] == b" \nlast\r"
    assert units.aside(buf, offs).tolist() == [False, True]
