"""Near-duplicates: what a hot bucket makes."""

import random


def test_rows_of_a_hot_bucket_are_bounded_by_its_texts(spark, monkeypatch):
    from leakscan.llm import order_minhash as M

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(120):  # each agrees with all others in most samples, and none reaches the similarity
        text = list(base)
        for at in rng.sample(range(300), 9):
            text[at] = word()
        texts.append(" ".join(text))
    texts += [texts[0] + " more", texts[1] + " less"]
    made, keep = {}, M.materialise

    def counted(df, name):
        out = keep(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(M, "materialise", counted)
    monkeypatch.setattr(M, "WINDOW", 4)
    told = {r["k"]: r["class_id"] for r in M.classes(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()}
    assert sum(made.get(n, 0) for n in ("met", "met-new", "met-links")) <= len(texts)

    parent = list(range(len(texts)))  # all pairs, by hand
    top = lambda x: x if parent[x] == x else top(parent[x])
    cut = [M.Shingler()(t.encode()).astype("uint32") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if M.verified(cut[i], cut[j], M.SIMILARITY):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert told == {i: top(i) for i in range(len(texts))} and told[120] == told[0]
    assert len(set(told.values())) > 20
