"""The canonical three-document index, as wire bytes."""

from graphloom.sources.wire import put

P = "scip clang c linux v6.12 "
STRUCT, FIELD, FUNCTION, TYPEDEF = 49, 15, 17, 55
OPS, READ, WRITE, OPEN = P + "ext4_file_operations#", P + "ext4_file_read_iter().", P + "ext4_file_write_iter().", P + "ext4_file_open()."
VFS_READ, VFS_WRITE, FOPS = P + "vfs_read().", P + "vfs_write().", P + "file_operations#"


def relationship(symbol, implementation=False, type_definition=False):
    return put(1, symbol) + put(3, int(implementation)) + put(4, int(type_definition))


def symbol(name, kind, display, enclosing="", relations=(), signature="", docs=()):
    out = put(1, name) + b"".join(put(3, d) for d in docs) + b"".join(put(4, r) for r in relations) + put(5, kind) + put(6, display)
    if signature:
        out += put(7, put(4, "c") + put(5, signature))
    return out + (put(8, enclosing) if enclosing else b"")


def occurrence(name, role, line, body=None, form="three"):
    if form == "three":
        out = put(1, [line, 4, 20])
    elif form == "four":
        out = put(1, [line, 4, line, 20])
    elif form == "single":
        out = put(8, put(1, line) + put(2, 4) + put(3, 20))
    else:
        out = put(9, put(1, line) + put(2, 4) + put(3, line) + put(4, 20))
    out += put(2, name) + put(3, role)
    if body:
        out += put(7, [body[0], 0, body[1], 1]) if form != "multi" else put(11, put(1, body[0]) + put(2, 0) + put(3, body[1]) + put(4, 1))
    return out


def document(path, symbols, occurrences):
    return put(1, path) + b"".join(put(2, o) for o in occurrences) + b"".join(put(3, s) for s in symbols) + put(4, "C")


def documents():
    fields = [symbol(OPS + f"{n}.", FIELD, n, OPS, [relationship(READ, type_definition=True)] if n == "read_iter" else ()) for n in ("read_iter", "write_iter", "open")]
    ext4 = document(
        "fs/ext4/file.c",
        [symbol(OPS, STRUCT, "ext4_file_operations", relations=[relationship(FOPS, implementation=True)], docs=["ext4 file operations table"]), *fields, *(symbol(s, FUNCTION, n, signature=f"static int {n}(void)") for s, n in ((READ, "ext4_file_read_iter"), (WRITE, "ext4_file_write_iter"), (OPEN, "ext4_file_open")))],
        [
            occurrence(OPS, 1, 100, (100, 120), "multi"),
            occurrence(READ, 1, 50, (50, 80), "single"),
            occurrence(WRITE, 1, 82, (82, 110), "four"),
            occurrence(OPEN, 1, 112, (112, 130)),
            occurrence(READ, 8, 105),
            occurrence(WRITE, 8, 106, form="single"),
            occurrence(OPEN, 8, 107, form="four"),
        ],
    )
    rw = document("fs/read_write.c", [symbol(VFS_READ, FUNCTION, "vfs_read"), symbol(VFS_WRITE, FUNCTION, "vfs_write")], [occurrence(VFS_READ, 1, 200, (200, 230)), occurrence(VFS_WRITE, 1, 240, (240, 270)), occurrence(READ, 8, 210), occurrence(WRITE, 8, 250)])
    fs = document("include/linux/fs.h", [symbol(FOPS, STRUCT, "file_operations"), symbol(P + "loff_t.", TYPEDEF, "loff_t")], [occurrence(FOPS, 1, 300, (300, 340)), occurrence(P + "loff_t.", 1, 10)])
    return [ext4, rw, fs]


METADATA = put(2, put(1, "scip-clang") + put(2, "0.3.5")) + put(3, "/kernel")


def index(docs=None, external=True):
    out = put(1, METADATA) + b"".join(put(2, d) for d in (documents() if docs is None else docs))
    if external:
        out += put(3, symbol(P + "sys_read().", FUNCTION, "sys_read")) + put(3, symbol(P + "__fdget_pos().", FUNCTION, "__fdget_pos"))
    return out
