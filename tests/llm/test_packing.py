"""op9: nothing lost, nothing overlaps, bins as small as they can be."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from mnemoframe.llm import packing as p
from mnemoframe.llm.token_counts import public_vocabulary

LIBRARY = Tokenizer.from_file(public_vocabulary())


def check_bins(rows, lengths=p.LENGTHS):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert len({m.bin_length for m in members}) == 1 and members[0].bin_length in lengths
        at = 0
        for m in sorted(members, key=lambda m: (m.bin_offset, m.n_tokens)):
            assert m.bin_offset == at
            at += m.n_tokens
        assert at <= members[0].bin_length and not any(at <= n < members[0].bin_length for n in lengths)
    return bins


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def brute(docs, lengths, end=2):
    """Sequences of one pack, by a scan of all bins."""
    pieces = []
    for doc_id, text in docs:
        ids = library_ids(text)
        pieces += [(doc_id, k, at, ids[at : at + max(lengths)]) for k, at in enumerate(range(0, len(ids), max(lengths)))]
    order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][3]))
    left, bins = sum(len(x[3]) for x in pieces), []
    for rest, k in zip(range(len(pieces), 0, -1), order):
        n = len(pieces[k][3])
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[2]))  # among equals the one filled last
        else:
            b = [p.open_length(n, left, left / rest, lengths), [], 0]
            bins.append(b)
        b[0], b[2] = b[0] - n, -rest
        b[1].append(k)
        left -= n
    return sorted(sorted(len(pieces[k][3]) for k in b[1]) for b in bins)


def test_query_writes_every_id_once(spark, middle):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    rows = p.op9_packing(spark, middle).collect()
    bins = check_bins(rows)
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc_id, parts in by_doc.items():
        ids = library_ids(docs[doc_id])
        for k, r in enumerate(parts):
            assert (r.piece, r.piece_start) == (k, k * max(p.LENGTHS))
            mine = ids[r.piece_start : r.piece_start + r.n_tokens]
            assert len(mine) == r.n_tokens and zlib.crc32(np.array(mine, "<u4").tobytes()) == r.ids_crc32
        assert sum(r.n_tokens for r in parts) == len(ids)
    assert sum(r.n_tokens for r in rows) / sum(v[0].bin_length for v in bins.values()) > 0.95


def test_bins_equal_a_scan(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    for lengths in (p.LENGTHS, (64, 256, 1024)):
        rows = p.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), lengths=lengths).collect()
        bins = check_bins(rows, lengths)
        assert sorted(sorted(m.n_tokens for m in b) for b in bins.values()) == brute(docs, lengths)


def test_best_fit_is_what_a_scan_finds():
    rng = random.Random(0)
    for _ in range(30):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 80))]
        where, offset, length = p.pack(sizes, (8, 16, 32))
        bins, order = [], sorted(range(len(sizes)), key=lambda k: -sizes[k])
        left = sum(sizes)
        for rest, k in zip(range(len(sizes), 0, -1), order):
            fits = [b for b in bins if b[0] >= sizes[k]]
            free = min((b[0] for b in fits), default=None)
            if free is None:
                bins.append([p.open_length(sizes[k], left, left / rest, (8, 16, 32)) - sizes[k]])
            else:
                next(b for b in fits if b[0] == free)[0] -= sizes[k]
            left -= sizes[k]
        assert len(set(where.tolist())) == len(bins)


def test_lengths_are_weighed():
    assert p.open_length(100, 100, 100, p.LENGTHS) == 2048  # the last piece takes the smallest
    assert p.open_length(100, 10**9, 100, p.LENGTHS) == 4096  # cheapest a token
    assert p.open_length(9000, 10**9, 500, p.LENGTHS) == 16384


def test_nulls_long_repeated_clashing_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "alpha beta"), (3, "w " * 40_000), (4, "seven"), (4, "seven"), (None, "gamma")] + [(9, "a b")] * 200
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece long, tokens string")
    got = p.pack_documents(df).collect()
    check_bins(got)
    want = sorted(zlib.crc32(np.array(ids[at : at + 16384], "<u4").tobytes()) for _, t in rows for ids in [library_ids(t)] for at in range(0, len(ids), 16384))
    assert sorted(r.ids_crc32 for r in got) == want and sum(r.doc_id is None for r in got) == 2
    several = p.sequences(df.coalesce(1), pack_ids=50).collect()
    assert len({r.bin_id for r in several}) == len(several) > 3 and sum(len(r["tokens"]) for r in several) == 4 * sum(r.n_tokens for r in got)
    assert p.pack_documents(df.limit(0)).count() == 0
