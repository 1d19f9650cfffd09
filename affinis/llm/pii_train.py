"""python -m affinis.llm.pii_train FOLDER [again]: trains the tagger of personal information on documents.parquet there.

The sample is bounded: at most SAMPLE texts, those of smallest hash, labelled by ``pii_rules``; to them come INVENTED
texts of ``pii_sentences``.  ``again`` goes on from the weights at hand.  Gradients of a step are computed by several processes.
"""

from __future__ import annotations

import multiprocessing
import os
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from affinis.llm import char_tagger as tagger
from affinis.llm import pii
from affinis.llm.pii_rules import learnt_names, with_learnt_names
from affinis.session import local_session

SAMPLE, INVENTED = 10_000, 16_000
RATE = 5e-3
HIDDEN, EPOCHS, BATCH, WORKERS = 40, 24, 256, 8


def main(folder: str, again: bool = False) -> None:
    spark = local_session(2)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL").select("text").distinct()
    texts = [r["text"] for r in docs.orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()]
    spark.stop()
    cut = len(texts) * 9 // 10
    given, family = learnt_names(texts)
    want = {t: [(k, f) for k, _, _, f in with_learnt_names(t, given, family)] for t in texts[cut:]}
    began = time.time()

    def say(epoch: int, loss: float, weights: dict) -> None:
        if epoch % 3 == 2 or epoch == EPOCHS - 1:
            pii.save(weights)
            spans = pii.tag_texts(weights, list(want))
            hit = extra = 0
            for t, s in zip(want, spans):
                got = [(k, f) for k, _, _, f in pii.checked(t, s)]
                hit += sum(x in got for x in want[t])
                extra += sum(x not in want[t] for x in got)
            print(f"epoch {epoch}, {time.time() - began:.0f} s: loss {loss:.3f}; held out: {hit} of {sum(map(len, want.values()))} pieces, {extra} others", flush=True)

    windows, tags = pii.training_windows(texts[:cut], INVENTED)
    with multiprocessing.get_context("fork").Pool(WORKERS) as pool:
        weights = tagger.train(windows, tags, pii.N_TAGS, hidden=HIDDEN, epochs=EPOCHS, batch=BATCH, rate=RATE, say=say, pool=pool, workers=WORKERS, start=pii.load() if again else None)
    pii.save(weights)


if __name__ == "__main__":
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    main(sys.argv[1], "again" in sys.argv[2:])
