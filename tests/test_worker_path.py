"""Tasks must run where the executors cannot import this package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from scholia.session import local_session
from scholia.operators import lexical, vectors
spark = local_session(2, "2g")
c = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "chunk_id bigint, text string")
q = spark.createDataFrame([(1, "red")], "query_id bigint, query string")
assert lexical.bm25_topk(c, q).count() == 1
v = vectors.embed_hashed(c).selectExpr("chunk_id AS id", "embedding AS vec")
assert vectors.near_dup_leaders(v).count() == 2
print("worked")
"""


def test_without_the_package_on_the_path(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "worked" in got.stdout, got.stderr[-2000:]
