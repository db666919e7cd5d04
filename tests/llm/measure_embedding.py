"""CPU seconds a GB if decontamination embedded the window at every word start, class by class: no test, run by hand.

python -m tests.llm.measure_embedding [folder with documents and benchmark] [bytes of text]
"""

import sys
import time

import numpy as np
import pyarrow.parquet as pq

from arcweave.llm import decontaminate as D


def main(folder: str = "/root/testdata/sf0.1", most: str = "60000") -> None:
    items = pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    finder = D.Finder(tuple((r["item_id"], r["text"]) for r in items), D.EDIT_SHARE, D.TARGET_RECALL)
    texts, size = [], 0
    for text in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist():
        texts.append(D.normal(text))
        size += len((text or "").encode())
        if size > int(most):
            break
    codes = D.codes_of(" ".join(texts))
    starts = np.flatnonzero(np.concatenate([[True], codes[:-1] == ord(" ")]))
    total = 0.0
    for t in finder.tables:
        if t.exact:
            continue
        longest, begin = max(len(s) for _, s in t.items), time.process_time()
        for at in range(0, len(starts), D.WINDOWS):
            some = starts[at : at + D.WINDOWS]
            t.candidates(codes, some, np.minimum(longest, len(codes) - some))
        spent = (time.process_time() - begin) / size * 1e9
        total += spent
        print(f"items up to {longest} characters, {t.tables} tables, recall {t.recall:.3f}: {spent:.0f} CPU seconds a GB")
    print(f"all classes: {total:.0f} CPU seconds a GB")


if __name__ == "__main__":
    main(*sys.argv[1:])
