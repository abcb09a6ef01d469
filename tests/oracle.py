"""A small pure-Python decoder, for comparison with the column one."""

from datetime import date

from tapeloom.functions.values import MONTHS, datetime_of_ticks


def decode_record(record: bytes, version) -> dict:
    out = {}
    for f in version.fields:
        raw = record[f.offset : f.offset + f.length].decode()
        text = {"left": raw.lstrip("b "), "right": raw.rstrip("b "), "both": raw.strip("b "), None: raw}[f.pad]
        if f.type == "str":
            out[f.name] = text
            continue
        if not raw.strip("b "):
            out[f.name] = None
        elif f.type in ("u8", "u64", "price"):
            out[f.name] = int(raw.lstrip("b "))
        elif f.type == "jiffies":
            out[f.name] = datetime_of_ticks(int(raw))
        elif f.type == "bool_yn":
            out[f.name] = raw == "Y"
        elif f.type == "date_dmmmy":
            out[f.name] = date(int(raw[5:]), MONTHS.index(raw[2:5].upper()) + 1, int(raw[:2].lstrip("b ")))
        elif f.type == "date_ymd":
            out[f.name] = date(int(raw[:4]), int(raw[4:6]), int(raw[6:]))
        elif f.type == "time_hms":
            out[f.name] = int(raw[:2]) * 3600 + int(raw[3:5]) * 60 + int(raw[6:])
    return out


def encode_record(version, values: dict) -> bytes:
    """Cells as given where they are text of full width, else zero-filled numbers or padded text."""
    out = b""
    for f in version.fields:
        v = values.get(f.name)
        if v is None:
            cell = "b" * f.length
        elif f.type == "str":
            cell = v.ljust(f.length, "b") if f.pad == "right" else v.rjust(f.length, "b")
        else:
            cell = v if isinstance(v, str) else f"{v:0{f.length}d}"
        assert len(cell.encode()) == f.length, (f.name, cell)
        out += cell.encode()
    return out
