"""What the token store leaves on disk while it is written."""

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from quillstone.llm import token_store


def _size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(urlparse(path).path) for f in names if not f.endswith(".crc"))


def test_staged_payload_goes_before_the_rest_is_merged(spark, tmp_path, monkeypatch):
    """All of the staged payload stayed until the recipes were written, beside its shuffle and the chunks."""
    words = F.expr("array_join(transform(sequence(1, 300), x -> concat('w', cast(pmod(xxhash64(id, x), 20000) as string))), ' ')")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), words.alias("text"))
    path = f"file://{tmp_path}/store"
    staged, drop = [], token_store.drop_dir
    monkeypatch.setattr(token_store, "drop_dir", lambda s, p: (staged.append(_size(f"{path}/staging")), drop(s, p))[-1])
    before = spark.conf.get(token_store.CLEAN, None)
    token_store.write(docs, path)
    assert spark.conf.get(token_store.CLEAN, None) == before
    assert staged == sorted(staged, reverse=True) and staged[-1] < 0.6 * staged[0]  # the recipes are what is left
    assert not os.path.exists(urlparse(f"{path}/staging").path)
    got = token_store.audit(spark, path)
    assert got.count() == 2000 and got.agg(F.sum("n_tokens")).first()[0] == spark.read.json(f"{path}/manifest").first()["n_tokens"]
