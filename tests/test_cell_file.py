import io

import pytest
from helpers import SMALL

from keyloom import catalog
from keyloom.errors import SortViolation
from keyloom.operators import layout
from keyloom.sources import cell_file


def made(n=3000, **options):
    out = io.BytesIO()
    w = cell_file.Writer(out, filter_keys=1000, **options)
    cells = [(b"r%07d" % (i // 2), b"cf", b"q%d" % (i % 2), 5, 4, b"v" * (i % 50)) for i in range(n)]
    for c in cells:
        w.append(*c)
    done = w.finish()
    return cells, out.getvalue(), done


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"block_size": 512, "leaf_target": 600}])
def test_round_trip(options):
    cells, data, done = made(**options)
    file = cell_file.File(data)
    assert list(file.cells()) == cells and done["file_bytes"] == len(data)
    assert file.trailer[7][0] == len(cells) and file.trailer[8][0] == (2 if "leaf_target" in options else 1)
    assert set(layout.REQUIRED_META) <= set(file.info)
    assert all(file.may_hold(c[0]) for c in cells[::37])
    assert sum(file.may_hold(b"x%d" % i) for i in range(300)) < 30
    assert sum(s for *_, s in file.blocks()) + cell_file.TRAILER_SIZE == len(data)


def test_index_keys_separate_blocks():
    cells, data, _ = made(block_size=512)
    file = cell_file.File(data)
    keys = [(k[2 : 2 + k[1]], k[3 + k[1] :]) for _, _, k in file.data_blocks()]
    assert len(keys) > 50 and all(a < b for a, b in zip(keys, keys[1:]))


def test_empty_file():
    _, data, _ = made(0)
    assert list(cell_file.File(data).cells()) == []


def test_order_and_damage():
    w = cell_file.Writer(io.BytesIO())
    w.append(b"b", b"f", b"", 1, 4, b"")
    for row, ts in ((b"a", 1), (b"b", 1), (b"b", 2)):
        with pytest.raises(SortViolation):
            w.append(row, b"f", b"", ts, 4, b"")
    w.append(b"b", b"f", b"", 0, 4, b"")
    _, data, _ = made(compression="none")
    with pytest.raises(ValueError, match="damaged"):
        list(cell_file.File(data[:100] + b"?" + data[101:]).cells())
    with pytest.raises(ValueError):
        cell_file.File(b"x" * 5000)


def test_written_by_spark(spark, tmp_path):
    cells = catalog.convert_orders(spark, SMALL)
    files = cell_file.write(cells, str(tmp_path)).collect()
    assert sum(f["entries"] for f in files) == cells.count()
    read = []
    for f in sorted(files, key=lambda f: bytes(f["first_row"])):
        parts = cell_file.layout_parts(f["path"])
        assert sum(b for _, b in parts) == f["file_bytes"] and sum(c == "FILE_INFO" for c, _ in parts) == 1
        read += list(cell_file.File(open(f["path"], "rb").read()).cells())
    assert [(r[0].decode(), r[5].decode()) for r in read] == [(r["row"], r["value"]) for r in cells.orderBy("row").collect()]


def test_filters_over_rows_and_qualifiers():
    cells, data, _ = made(filter_kind="rowcol")
    file = cell_file.File(data)
    assert file.info["BLOOM_FILTER_TYPE"] == b"ROWCOL" and file.info["LAST_BLOOM_KEY"] == layout.rowcol_key(cells[-1][0], cells[-1][2])
    assert all(file.may_hold(c[0], c[2]) for c in cells[::7])
    assert sum(file.may_hold(c[0], b"none") for c in cells[::7]) < 60 and len(file.filters) == 3
