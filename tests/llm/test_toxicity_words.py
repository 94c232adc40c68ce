"""Words are counted one by one, however many there are."""

from collections import Counter

import numpy as np

from trackloom.llm import toxicity


def test_words_do_not_share_counts(spark):
    # 400 documents of 800 words of their own: more words than the 262,144 bins that once held them
    rows = [(n, " ".join(f"own{n}x{i}" for i in range(800)) + (" vile" if n % 8 == 0 else " kind"), int(n % 8 == 0)) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    counts = toxicity.word_counts(docs.select("text", "toxic")).toPandas()
    want = Counter(w for _, text, _ in rows for w in set(text.split()))
    known = counts[counts["word"].notna()]
    assert len(known) == len(want) and int((known["clean"] + known["toxic"]).sum()) == sum(want.values())
    documents = counts[counts["word"].isna()].iloc[0]
    assert (documents["clean"], documents["toxic"]) == (350, 50)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    odds = model.of("kind vile " + " ".join(f"own{n}x{i}" for n in range(400) for i in range(0, 800, 8)))
    assert odds[0] < 0 < odds[1] and not np.any(odds[2:])
