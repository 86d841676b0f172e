"""SentencePiece, the Merkle manifest and collocations against their definitions, and in edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import collocations, merkle, pieces

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
rng = random.Random(11)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Ties, repeated rows, nulls in any column, empty and very long texts, one source with most rows."""
    vocab = ["the", "old", "river", "Bank", "naïve", "中文", "a", "of", "x1", "😀", "\x00", "rain"]
    sentence = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(n))
    out = [(i, sentence(rng.randrange(1, 40)), rng.choice(["en", "de", "en", None]), "hot" if i % 3 else f"s{i % 11}", i) for i in range(420)]
    out += [(5, "one two", "en", "hot", 7), (5, "one two", "en", "hot", 7), (None, "lost id", "en", None, None), (None, None, None, None, None), (600, None, "en", "", 0), (601, "", "en", "ü", 0), (602, " \t\n ", "en", "z", 4)]
    return out + [(603, "word " * 30_000, "en", "hot", 150_000), (604, "a" * 50_000, "de", "lonely", 50_000), (605, "deep river bank. " * 60 + "\n" * 9, "en", "hot", 1), (606, "deep old river bank runs, " * 50, "en", "hot", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that clash with names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("tag", "h", "leaf", "_p", "_at", "tree", "n", "f", "k", "phrase", "rank", "ids", "score"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# SentencePiece


def _varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _message(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value if isinstance(value, bytes) else _varint(number << 3) + _varint(value)


def changed(rule=None, dummy=1, squeeze=0, fallback=1, own=()):
    """The given model with other normalisation, a character map of the library's own rules, or pieces of the user's own."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    compiled = b""
    if rule:
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        compiled = dict(pieces._fields(next(v for n, v in pieces._fields(proto) if n == 3)))[2]
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    out = b""
    for number, value in pieces._fields(raw):
        if number == 1 and not fallback and value.endswith(b"\x18\x06"):
            value = value[:-2]
        if number == 2:
            for p in own:
                out += _message(1, _message(1, p.encode()) + _message(3, pieces.USER_DEFINED))
            value += _message(35, fallback)
        if number == 3:
            value = _message(1, b"x") + _message(2, compiled) + _message(3, dummy) + _message(4, squeeze)
        out += _message(number, value)
    return out


ALPHABET = [*"abcdeinorst  ' .\n\t", "  ", "▁", "é", "中", "ｱ", "ﬁ", "①", "́", "é", "Ａ", "㌔", "😀", "\xa0", "　", "\x00", "<s>", "<0x41>", "½", "the ", "tion", "한", "�"]
CONFIGS = [{}, {"dummy": 0}, {"squeeze": 1}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc", "squeeze": 1}, {"rule": "nfkc_cf", "dummy": 0}, {"fallback": 0}, {"own": ("n.", "a①", "t.n")}, {"own": ("e.", "㌔㌔"), "rule": "nfkc", "squeeze": 1}]


@pytest.mark.parametrize("config", CONFIGS, ids=str)
def test_pieces_against_the_library(config):
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = changed(**config)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Model(proto)
    cached = pieces.Encoder(own)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25)))
        want = [dict(pieces._fields(v)) for n, v in pieces._fields(library.encode(text, out_type="serialized_proto")) if n == 2]
        ids, spans = own.encode(text)
        assert [(i, a, b) for i, (a, b) in zip(ids, spans, strict=True)] == [(d.get(2, 0), d.get(4, 0), d.get(5, 0)) for d in want], text
        assert own.decode(ids) == library.decode(ids)
        n, of_ids, of_text, _, kept, places = cached.encode(text, True)
        assert (n, of_ids, of_text, kept) == (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids)), ids)
        assert places.tolist()[1:] == [b for _, b in spans]
        some = [rng.choice([0, 1, 2, 29871, *range(3, 300)]) for _ in range(6)]
        assert own.decode(some) == library.decode(some)


def test_pieces_of_documents(docs, rows, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    made = pieces.piece_encode(docs)
    got = made.collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)
    texts = {(i, text or "") for i, text, *_ in rows}
    for r in got:  # the spans tile the source
        assert r.begins[1:] == r.ends[:-1] and hashlib.sha256(np.array(r.ends, "<i8").tobytes()).hexdigest() == r.spans_sha256
    back = pieces.piece_decode(made).collect()
    assert {(r.doc_id, r.text) for r in back} == texts
    short = pieces.piece_encode(docs, with_ids=False)
    assert short.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    assert pieces.piece_encode(empty).count() == 0 == pieces.piece_decode(pieces.piece_encode(empty)).count()


def test_pieces_in_blocks_and_generations(monkeypatch):
    enc = pieces.encoder()
    texts = ["".join(rng.choice(ALPHABET) for _ in range(300)) for _ in range(20)]
    want = [enc.encode(t, True) for t in texts]
    monkeypatch.setattr(pieces, "BLOCK", 7)
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 5)
    enc.forget()
    for t, w in zip(texts, want):
        got = enc.encode(t, True)
        assert got[:5] == w[:5] and got[5].tolist() == w[5].tolist()
    enc.forget()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(_message(2, _message(3, 1)))


# Merkle manifest


def H(parts):
    return sha("".join(parts))


def leaf(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1]))


def tree(digests):
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, i in enumerate(at):
            g = i // 3 * 3
            paths[k].append(("".join(level[g:i]), "".join(level[i + 1 : g + 3])))
        at, level = [i // 3 for i in at], [H(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    per, out = [], []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        per.append((members, *tree([leaf(r) for r in members])))
    root, crown = tree([top for _, top, _ in per])
    for (members, top, paths), above in zip(per, crown):
        for r, path in zip(members, paths):
            node = leaf(r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf((r[0], r[1].replace("\n", ""), *r[2:]))
            for a, b in path + above:
                node = H([a, node, b])
            out.append((r[0], leaf(r), top, root, H(x for ab in path + above for x in ab), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [4, 1])
def test_merkle(docs, rows, levels):
    if levels == 1:
        docs, rows = docs.where("doc_id < 90 OR doc_id IS NULL"), [r for r in rows if r[0] is None or r[0] < 90]
    got = sorted((tuple(r) for r in merkle.manifest(docs, levels).collect()), key=repr)
    assert got == manifest(rows)
    if levels == 4:
        assert 0 < sum(not g[-1] for g in got) < len(got)


def test_merkle_small(spark, empty):
    assert merkle.manifest(empty).count() == 0 and merkle.root(spark, merkle.manifest(empty)) is None
    one = [(1, "a\nb", "en", "s", 3)]
    got = merkle.manifest(spark.createDataFrame(one, DOCS)).collect()
    assert [tuple(r) for r in got] == manifest(one) and got[0].root == got[0].subroot == got[0].leaf


# Collocations


def phrases(rows, most=4):
    f, n = collections.Counter(), collections.Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def best(rows, least, first):
    f, n = phrases(rows)
    c = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in c.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[lang, p[i : i + k]]}
    out = collections.defaultdict(list)
    for (lang, p), a in c.items():
        if (lang, p) not in inside:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:first], 1))


@pytest.mark.parametrize(("least", "first", "share"), [(30, 2000, 50_000), (3, 2000, 10), (5, 7, 10)])
def test_collocations(docs, rows, least, first, share, monkeypatch):
    monkeypatch.setattr(collocations, "SHARE", share)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, first=first).collect())
    want = best(rows, least, first)
    assert got == want and len(want) >= 5
    if least == 30:
        assert "deep old river bank" in {r[2] for r in got} and not {"old river bank", "deep old river"} & {r[2] for r in got}


@pytest.mark.parametrize("flush", [1, 10, 1 << 21])
@pytest.mark.parametrize("cut", [1, 64, 1 << 22])
def test_buffers(rows, flush, cut, monkeypatch):
    """Buffers of any size and texts cut anywhere count the same."""
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "SLICE", cut)
    some = [r for r in rows[:40] + rows[-2:] if r[1]]
    buffer, got, total = collocations._Buffer("en", range(1, 5), None), collections.Counter(), 0
    batches = [b for r in some for b in buffer.add(r[1].encode())] + list(buffer.flush())
    for batch in batches:
        for phrase, n in zip(batch.column("phrase").to_pylist(), batch.column("f").to_pylist()):
            if phrase is None:
                total += n
            else:
                got[phrase] += n
    f, n = phrases([(0, r[1], "en") for r in some])
    assert got == {" ".join(p): a for (_, p), a in f.items()} and total == n["en"]


def test_bitmap_holds_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", (1 << 15, 1 << 16))
    pairs = [("en", f"w{i} v{i * 7}") for i in range(3000)] + [("de", "a b")]
    held = collocations.bitmap(spark.createDataFrame(pairs, "lang string, phrase string"))
    assert len(held) * 8 == 1 << 15
    for lang, phrase in pairs:
        first, second = (collocations._hashes([w.encode()], lang) for w in phrase.split())
        place = int(collocations._mixed(first, second, len(held) * 8)[0])
        assert held[place >> 3] >> (place & 7) & 1
    assert np.unpackbits(held).sum() <= len(pairs)


def test_collocations_of_little(spark, empty):
    assert collocations.collocations(empty).count() == 0
    few = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (3, ",,,", "en", "s", 3)], DOCS)
    assert collocations.collocations(few).count() == 0
    assert [tuple(r) for r in collocations.collocations(few, least=1).collect()] == [("en", 1, "a b c", 1, 1, 1, 3, 1_000_000)]


def test_scores_pass_64_bits(spark):
    big = 9 * 10**18
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    got = row.select(collocations._score(row.a, row.l.cast("decimal(20,0)") + row.r).alias("s")).first()
    assert got.s == 2_000_000 * big // (2 * big)
