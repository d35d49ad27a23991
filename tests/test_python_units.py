from codequery.sources import python_units as p


def test_units_of_a_file():
    rows = p.parse("a.py", b"import os\n@d\ndef f(x):\n  if x and y: return g(h(x))\nclass C:\n  def m(self): self.q()\n")
    assert [(r[3], r[4], r[6], r[7]) for r in rows] == [("file", "a.py", 1, 6), ("function", "f", 2, 4), ("class", "C", 5, 6), ("method", "C.m", 6, 6)]
    assert rows[1][9:11] == (["g", "h"], 3) and len({r[2] for r in rows}) == 4


def test_faults_stay_in_their_file():
    assert [p.parse("x.py", d)[0][-1] for d in (b"def (", b"\xff", b"a\0", None)] == ["failed", "failed", "skipped", "skipped"]
