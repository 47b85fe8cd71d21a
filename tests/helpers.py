SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    """Rows with columns in the order of their names, sorted; doubles rounded."""
    columns = sorted(frame.columns)
    frame = frame[columns].copy()
    for c in columns:
        if str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].round(6)
        frame[c] = [None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in frame[c].astype(object).where(frame[c].notna(), None)]
    return columns, sorted(map(tuple, frame.itertuples(index=False)), key=str)
