from collections import Counter

from pyspark.sql import functions as F

from codequery.operators import code_graph, knowledge
from codequery.sources import files

TEXT = "import os.path\nimport os\nfrom web import app\n@app.get('/x')\ndef read():\n    return load()\ndef load(): pass\nclass Item(db.BaseModel):\n    def save(self): pass\n"


def test_knowledge_graph(spark):
    rows = [("m.py", len(TEXT), bytearray(TEXT.encode())), ("bad.py", 5, bytearray(b"def ("))]
    units = files.parse(spark.createDataFrame(rows, "path string, length long, content binary"))
    units = units.withColumn("repository_id", F.lit("r")).withColumn("commit_sha", F.lit("c"))
    nodes = knowledge.nodes(units).collect()
    assert Counter(n.kind for n in nodes) == {"REPOSITORY": 1, "FILE": 2, "LIBRARY": 2, "FUNCTION": 3, "CLASS": 1, "API_ENDPOINT": 1, "DATABASE_ENTITY": 1}
    assert {n.name for n in nodes if n.kind in ("LIBRARY", "API_ENDPOINT")} == {"os", "web", "GET /x"}
    found = knowledge.edges(units, code_graph.build(units)[0]).collect()
    assert Counter(e.kind for e in found) == {"CONTAINS": 3, "IMPORTS": 2, "DEFINES": 3, "EXPOSES": 1, "USES": 1, "CALLS": 1}
    ids = {n.id for n in nodes}
    assert all(e.source in ids and e.target in ids for e in found)
