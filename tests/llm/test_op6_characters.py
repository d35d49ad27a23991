import random

import pyarrow as pa

from codequery.llm import op6_line_dedup as op6
from codequery.llm.components import Forest

WORDS = {
    "en": "river stone bright morning carry window letter garden silver market winter engine",
    "de": "schöne größe häuser übung straße mädchen frühling können fußgänger glück märz körper",
    "ru": "река камень яркое утро нести окно письмо сад серебро рынок зима мотор",
    "ja": "川の石が朝に光る 窓を開けて手紙を読む 庭で銀の花を見る 冬の市場へ行く",
}


def own_shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def lines():
    rng = random.Random(4)
    out = []
    for words in WORDS.values():
        for _ in range(12):
            line = " ".join(rng.choice(words.split()) for _ in range(rng.randint(6, 12)))
            at = rng.randint(len(line) // 3, 2 * len(line) // 3)
            out += [line, line[:at] + "#" + line[at + 1 :]]
    return out


def test_sets_are_the_sets_of_five_characters():
    for line in [*lines(), "a", "a\U0001f600b\U0001f600c\U0001f600"]:
        assert len(op6.shingles(line.encode())) == len(own_shingles(line.ljust(5, "\0")))
    assert len(op6.shingles(b"abc\xff\xfe\xffdef")) == 5


def test_one_changed_character_links_where_five_character_sets_agree(spark):
    made = lines()
    sets = [own_shingles(x) for x in made]
    root = list(range(len(made)))
    for b in range(len(made)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[a] if r == root[b] else r for r in root]
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    want = {i: line if i in first.values() else "" for i, line in enumerate(made)}
    assert list(want.values()).count("") > 20
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for size in (1024, 2):
        assert {r.doc_id: r.text for r in op6.dedup(docs, unit_lines=size, block_bytes=1 << 10 + size, range_bytes=1 << 11).collect()} == want


def test_a_unit_in_parts_links_what_one_part_links():
    """Lines that stay apart from their part's leader visit the other parts."""
    rng = random.Random(9)
    base = [" ".join(rng.choice(WORDS["en"].split()) for _ in range(12)) for _ in range(3)]
    texts = sorted({b[:i] + c + b[i + 1 :] for b in base for i in range(0, len(b), 7) for c in "#+"})
    unit = op6._Unit(list(range(len(texts))), [op6.shingles(t.encode()) for t in texts], 0.8, Forest())
    unit.apart()
    sets = [own_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    together = lambda f: {(a, b) for a in range(len(texts)) for b in range(a) if f(a) == f(b)}
    assert together(unit.forest.find) == together(root.__getitem__)


def test_places_and_bands_of_a_block():
    rows = pa.table({"text": ["a\n B \n\nb", "b\na", None, "b\na"], "id": pa.array([5, 2, 1, 2], pa.int64())})
    lines = op6.Lines(3, rows, 0)
    assert sorted(lines.norm) == ["a", "b"] and len(lines.line) == 7
    place = {n: tuple(p) for n, p in zip(lines.norm, lines.places().tolist(), strict=True)}
    assert {n: (p[0], p[1], p[3]) for n, p in place.items()} == {"a": (1, 2, 1), "b": (1, 2, 0)}
    assert int((lines.at == lines.first[lines.line]).sum()) == 4  # both copies of one row hold them
