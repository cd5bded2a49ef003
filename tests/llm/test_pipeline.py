import collections

from corpus_pipeline import MIX_BLOCK_WORDS, ORACLE_SQL, STAGES, run
from markloom.llm.common import read, written
from markloom.llm.toxicity import with_scores
from tests.llm import test_mixing, test_near, test_packing

SF = "/root/testdata/sf0.001"


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def plain(rows):
    return [(r.doc_id, r.text, r.source) for r in rows]


def test_every_stage_against_brute_force(spark):
    assert [name for name, _ in STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and ORACLE_SQL is None
    docs = read(spark, SF)
    outputs = [docs]
    for name, stage in STAGES:
        outputs.append(written(stage(spark, outputs[-1], SF), name))
    assert all(o.columns == docs.columns for o in outputs[:-1])
    rows = [plain(o.collect()) for o in outputs[:-1]]

    scores = {r.doc_id: r.score for r in with_scores(docs, read(spark, SF, "labels"), "score").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r[0]] < 0.5)

    best = {}
    for r in rows[1]:
        best[bare(r[1])] = min(best.get(bare(r[1]), (1, 0, r)), (-len(r[1] or ""), r[0], r))
    assert sorted(rows[2]) == sorted(b[2] for b in best.values())

    groups = test_near.expected(rows[2], 5)
    assert sorted(str(r[0]) for r in rows[3]) == sorted({component for _, _, component in groups})

    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, source in rows[3]:
        sizes[source] += len(test_mixing.WORD.findall(text or ""))
    for _, text, source in rows[4]:
        taken[source] += len(test_mixing.WORD.findall(text or ""))
    for source, target in test_mixing.water_level(sizes).items():
        assert abs(taken[source] - target) <= MIX_BLOCK_WORDS / 2
    assert max(collections.Counter(r[0] for r in rows[4]).values()) <= 3

    test_packing.check(outputs[-1].collect(), rows[4], 2048)
    assert sorted(map(str, run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, outputs[-1].select("doc_id", "piece", "ids_crc32").collect()))
