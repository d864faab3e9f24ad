"""The encoder's memo of pieces: what it holds, and blocks with more pieces than fit."""

import numpy as np
import pytest

from quillstone.llm import _common, _encode


def _bytes(known) -> int:
    return sum(a.nbytes for a in vars(known).values() if isinstance(a, np.ndarray))


def test_memo_takes_what_its_pieces_need():
    """The pipeline's pack was stopped for an executor's memory: every worker's memo had 48 MB of tables before its first piece."""
    known = _encode.Known()
    assert _bytes(known) < 2 << 20
    h = np.random.default_rng(3).integers(1, 1 << 63, 300_000).astype(np.uint64)
    for at in range(0, len(h), 30_000):
        known.add(h[at : at + 30_000], [b"\1\0\0\0\2\0\0\0"] * 30_000)
    assert (known.find(h) == np.arange(len(h))).all()
    assert _bytes(known) < 24 << 20


def test_memo_of_many_ids_is_emptied(monkeypatch):
    monkeypatch.setattr(_encode, "IDS", 5000, raising=False)
    known = _encode.Known()
    for i in range(100):
        known.add(np.arange(100 * i + 1, 100 * i + 101, dtype=np.uint64) << np.uint64(40), [b"\7\0\0\0" * 20] * 100)
    assert known.used <= 5000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_block_with_more_pieces_than_the_memo_holds(monkeypatch, name):
    monkeypatch.setattr(_encode, "MEMO", 100)
    e = _encode.encoder(name)
    monkeypatch.setattr(e, "known", _encode.Known())
    texts = [" ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(a, a + 400)) for a in (0, 300, 100)]
    for _ in range(2):
        ids, bounds = e.batch(texts)
        for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
            assert ids[a:b].tolist() == e.full.encode(t, add_special_tokens=False).ids


def test_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"id": [b.num_rows]})

    with _common.short_batches(spark, 100):
        assert max(r[0] for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "id long").collect()) == 100
    assert spark.conf.get(name) == before
