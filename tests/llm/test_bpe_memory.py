"""What a worker of bpe holds between chunks."""

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from siftline.llm import bpe


def test_memory_of_a_chunk_is_given_back_before_the_next(monkeypatch):
    """Arrow's pool is asked after each chunk, not after a whole task, and tables that were copied are let go; ids and texts are whole."""
    freed = []
    monkeypatch.setattr(bpe.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: freed.append(1)))
    texts = ["one two three", "", None, "four  five\nsix", "naïve café " * 5, "x"]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = list(bpe._encoder(path, 1, True, (20, 100, 500, 7))(iter([batch])))
    assert len(out) == len(freed) > 1
    assert [t.as_py().decode() for b in out for t in b.column("decoded")] == [t or "" for t in texts]
    own = bpe._bpe(path, (20, 100, 500, 7))
    assert own.con.execute("select count(*) from merges").fetchall()[0][0] > 50_000
    assert not own.con.execute("select * from duckdb_views() where view_name in ('m', 'v')").fetchall()
