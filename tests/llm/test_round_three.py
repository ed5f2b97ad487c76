"""Documents counted by id, values that must stay apart, documents without an id, long texts of numbers."""

import random

import pyarrow as pa
from texts import prose

from vulnloom.llm import decontaminate, pii, quality_rules, textkit

DOCS = "doc_id long, text string, source string"


def test_rows_of_one_id_are_one_document(spark):
    shared = "a line that many rows have in common"
    body = lambda k: prose(k, 40)
    copies = [(7, f"{body(k)}\n{shared}", "a") for k in range(20)]
    others = [(100 + k, f"{body(100 + k)}\nanother line that documents share", "a") for k in range(20)]
    nameless = [(None, f"{body(300 + k)}\na third line without any id", "a") for k in range(20)]
    got = quality_rules.judge(spark.createDataFrame([*copies, *others, *nameless], DOCS)).collect()
    removed = {}
    for r in got:
        removed.setdefault(r.doc_id if r.doc_id in (None, 7) else 100, []).append(r.n_removed_words)
    assert len(got) == 60 and set(removed[7]) == {0}
    assert sorted(removed[100]) == [0] + [5] * 19 and sorted(removed[None]) == [0] + [6] * 19


def test_different_values_must_not_become_one(spark):
    form = "a farmer sells {} eggs on monday and {} eggs on friday, keeps {} for the family and gives {} to the neighbours; how many eggs remain in the basket"
    items = spark.createDataFrame([(1, form.format(12, 34, 56, 78))], "item_id long, text string")
    docs = [(1, form.format(12, 34, 56, 78)), (2, form.format(21, 43, 65, 87)), (3, form.format(7, 7, 7, 7))]
    rows = [(i, f"{prose(i, 60)} {t} {prose(i + 50, 60)}") for i, t in docs]
    got = {r.doc_id: r.reparameterised for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: False, 2: True}


def test_documents_without_an_id(spark):
    item = "the quick survey of distant planets shows that most of them have no water at all, said the astronomer to the committee"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, prose(1, 50)), (2, f"{prose(2, 40)} {item}"), (None, item), (None, f"{prose(3, 30)} {item}"), (None, prose(4, 50)), (None, None)]
    left = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(1, prose(1, 50)), (None, prose(4, 50)), (None, None)], key=repr)


def test_a_long_text_of_numbers(spark):
    rng = random.Random(1)
    model = pii.train(spark.createDataFrame([(k, f"{prose(k, 6)} call +1555000{1000 + k} now or +1555000{1000 + k} later, room {k}") for k in range(40)], "doc_id long, text string"))
    text = " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(40_000)) + " +15550007777 and 15550007777"
    block = next(textkit.blocks(pa.array([text])))
    graph, _ = pii.graph_of(block)
    assert len(graph.chain) <= len(graph.doc) and len(graph.skip) <= 2 * len(graph.doc)
    whole, base, spans = pii.scan_block(block, model, pii.PiiOptions())[0]
    assert whole == text and [text[s:e] for _, s, e in base] == ["+15550007777"] and set(base) <= set(spans)
