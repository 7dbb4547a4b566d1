"""Packed pairs of hashes and keys: nothing is lost, and they take few bytes."""

import numpy as np

from millrace.llm import jaccard_join


def test_packed_pairs_come_back_in_few_bytes():
    rng = np.random.default_rng(3)
    keys = np.append(rng.integers(0, 1 << 64, 5000, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64))
    key = np.repeat(keys, rng.integers(1, 4, len(keys)))
    hashes = rng.integers(0, 1 << 64, len(key), np.uint64)
    hashes[1::7] = hashes[0]
    for buckets in (1, 12):
        batches = list(jaccard_join._dealt([hashes], [key], buckets))
        found, names = jaccard_join._gathered(iter(batches))
        place = (hashes >> np.uint64(40)) % np.uint64(buckets)
        wanted = (place << np.uint64(40)) | (hashes & np.uint64((1 << 40) - 1))
        assert sorted(zip(found.tolist(), names.tolist())) == sorted(zip(wanted.tolist(), key.tolist()))
        rows = [r for b in batches for r in b.to_pylist()]
        assert sum(len(r["hashes"]) for r in rows) == 5 * len(key)
        # sorted keys are sent by differences: the highest bytes, together at the end, are nearly all 0
        for r in rows:
            n = len(r["keys"]) // 8
            assert np.frombuffer(r["keys"], np.uint8)[7 * n :].mean() < 4
