"""Archives and class files for tests, built byte by byte with fixed times."""

import io
import struct
import zipfile


def class_bytes(name, super_name="java/lang/Object", strings=(), refs=(), calls=(), major=61):
    pool = []

    def add(raw):
        pool.append(raw)
        return len(pool)

    def utf8(t):
        raw = t.encode()
        return add(b"\x01" + struct.pack(">H", len(raw)) + raw)

    def cls(t):
        return add(b"\x07" + struct.pack(">H", utf8(t)))

    this = cls(name)
    parent = cls(super_name) if super_name else 0
    for t in strings:
        add(b"\x08" + struct.pack(">H", utf8(t)))
    for t in refs:
        cls(t)
    for owner, member in calls:
        o = cls(owner)
        nat = add(b"\x0c" + struct.pack(">HH", utf8(member), utf8("()V")))
        add(b"\x0a" + struct.pack(">HH", o, nat))
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, major, len(pool) + 1) + b"".join(pool) + struct.pack(">HHH", 33, this, parent) + bytes(8)


def jar(entries, compression=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in entries.items() if isinstance(entries, dict) else entries:
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = compression
            z.writestr(info, data)
    return out.getvalue()
