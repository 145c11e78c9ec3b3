import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabprobe.llm import packing
from tabprobe.llm.exact_dedup import LOWER, UPPER, exact_duplicates
from tabprobe.llm.packing import Limits, Packer, Piece, pack
from tabprobe.llm.pieces import split
from tabprobe.llm.queries import tokenizer
from tabprobe.llm.token_counts import Merges, token_counts

BPE = tokenizer("byte_bpe_50k.json")


def lowered(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_duplicates(documents, prose, ranges):
    got = exact_duplicates(documents(prose), ranges).collect()
    groups = defaultdict(list)
    for i, t in prose:
        groups[lowered(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for i in ids:
            want[(i, best, len(ids), sha)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_hot_text_is_spread_and_summed_up(documents):
    rows = [(i, "Same text" if i % 3 else f"text {i}") for i in range(900)]
    got = exact_duplicates(documents(rows), 8)
    assert got.filter("group_size = 600 and keep_id = 899").count() == 600
    assert got.filter("kept").count() == 301


def test_empty_tables(documents, spark):
    none = documents([])
    assert exact_duplicates(none).count() == 0
    assert token_counts(none, BPE).count() == 0
    assert pack(none, BPE).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_counts(documents, prose, library):
    got = Counter(map(tuple, token_counts(documents(prose), BPE, limit=300).collect()))
    want = Counter()
    for i, t in prose:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 300)] += 1
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab's tlrevmd'\n\t 1²٣é́🙂.,<|endof>"), max_size=60))
def test_pieces_and_merges_follow_the_library(text):
    import tokenizers
    from tokenizers import Tokenizer

    codes, starts, ends, _ = split([text])
    pieces = [text[a:b] for a, b in zip(starts, ends)]
    pre = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == pieces
    merges = _one(Merges)
    whole = _one(Tokenizer.from_file)
    if "<|endoftext|>" not in text:
        assert sum(merges.count(p) for p in pieces) == len(whole.encode(text).ids)


_made = {}


def _one(make):
    return _made.setdefault(make, make(BPE) if make not in _made else None)


def test_packing_round_trip(documents, prose, library):
    rows = pack(documents(prose), BPE).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, tuple(ids), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    wanted = defaultdict(list)
    for i, t in prose:
        wanted[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for i, lists in wanted.items():
        if len(lists) == 1:
            whole = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
            assert whole == lists[0]
            assert {n for _, _, n in pieces[i]} == {len(whole)}
        assert sum(len(x[1]) for x in pieces[i]) == sum(map(len, lists))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60),
       st.integers(1, 64), st.integers(1, 5), st.integers(1, 64))
def test_no_limit_is_passed(examples, tokens, segments, loss):
    limits = Limits(tokens, segments, loss)
    packer = Packer(limits, width=3)
    for i, (n, prompt) in enumerate(examples):
        packer.add(Piece(i, 0, np.arange(n, dtype=np.uint32), n - min(prompt, n), n))
    packer.finish()
    of, seen = defaultdict(list), defaultdict(list)
    for piece, sequence, offset in packer.done:
        of[sequence].append((offset, piece))
        seen[piece.doc].append((piece.start, len(piece.ids), piece.loss))
    for parts in of.values():
        assert sum(len(p.ids) for _, p in parts) <= tokens
        assert len(parts) <= segments
        assert sum(p.loss for _, p in parts) <= loss
    for i, (n, prompt) in enumerate(examples):
        at = 0
        for start, length, bearing in sorted(seen[i]):
            assert start == at and length > 0
            at += length
            assert bearing == max(0, at - max(prompt, start)) if at > prompt else bearing == 0
        assert at == n


def test_prompt_tokens_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 3), (2, None, None)],
                                 "doc_id long, text string, prompt int")
    rows = pack(docs.coalesce(1), BPE, limits=Limits(64, 1, 2), prompt_tokens="prompt").collect()
    assert all(r.length <= 5 for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 1) == 7


def test_crc_of_query_is_of_little_endian_ids(spark, sf_dir):
    from tabprobe.llm.queries import op6_packing

    rows = op6_packing(spark, sf_dir).orderBy("doc_id", "start").limit(5).collect()
    encoder = packing.Encoder(BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        ids = np.append(encoder.ids([texts[r.doc_id]])[0], np.uint32(1))
        own = ids[r.start:r.start + r.length].astype("<u4").tobytes()
        assert zlib.crc32(own) == r.ids_crc32
