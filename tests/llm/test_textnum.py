import numpy as np
import pyarrow as pa

from tabwright.llm import textnum as tn


def test_hash_depends_on_the_bytes_alone():
    buf = np.frombuffer(b"xx abcde yy abcde abcdf", np.uint8)
    p = tn.prefix_sums(buf)
    h = tn.substring_hash(p, np.array([3, 12, 18]), np.array([8, 17, 23]))
    assert h[0] == h[1] != h[2]


def test_rows_stay_apart_and_nulls_are_empty():
    col = pa.array(["ab cd", None, "", "ef", "é  x"])
    got = []
    for lo, hi, buf, off in tn.text_blocks(col, 4):
        start, end, first = tn.words(buf, off)
        for r in range(hi - lo):
            got.append([bytes(buf[a:b]).decode() for a, b in zip(start[first[r]:first[r + 1]], end[first[r]:first[r + 1]])])
    assert got == [["ab", "cd"], [], [], ["ef"], ["é", "x"]]
