"""Foreign ledgers in SQLite files."""

import sqlite3

import pytest

from tessella.operators import ledger
from tessella.sources import sqlite_ledger
from tessella.sources.sqlite_ledger import read_ledger
from tessella.sources.tree import LEDGER

KINDS = {"hash": "BLOB", "roots": "TEXT", "filters": "TEXT", "failed_json": "TEXT", "keep_paths": "TEXT", "path": "TEXT", "op_kind": "TEXT", "target_dir": "TEXT", "orig_path": "TEXT", "dest_path": "TEXT", "link_src": "TEXT", "state": "TEXT", "err": "TEXT"}


def made(path, rows, less=()):
    db = sqlite3.connect(path)
    for name, columns in LEDGER.items():
        own = [c for c in columns if f"{name}.{c}" not in less]
        db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} ' + ('INTEGER PRIMARY KEY' if c == 'id' else KINDS.get(c, 'INTEGER')) for c in own)}, extra TEXT)")
        for r in rows.get(name, []):
            db.execute(f"INSERT INTO {name} ({', '.join(r)}) VALUES ({', '.join('?' * len(r))})", list(r.values()))
    db.commit()
    db.close()
    return str(path)


def test_tables_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sqlite_ledger, "RANGE_ROWS", 7)
    items = [{"id": k * 3, "op_id": 1, "orig_path": f"/home/f{k}", "hash": bytes([1]) * 32, "size": k, "mtime_ns": 1, "state": "done", "err": None} for k in range(1, 40)]
    rows = {"scan_history": [{"id": 5, "saved_at": 9, "roots": '["/home/"]', "paranoid": 1, "filters": b"{}"}], "op_records": [{"id": 1, "op_kind": "move", "created_at": 7, "undoable": 1}], "op_items": items}
    rows["op_items"][0]["size"] = "not a number"
    tables = read_ledger(spark, made(tmp_path / "a.db", rows))
    got = {r["id"]: r for r in tables["op_items"].collect()}
    assert sorted(got) == [i["id"] for i in items] and got[3]["size"] is None and got[117]["size"] == 39 and bytes(got[6]["hash"]) == bytes([1]) * 32
    assert tables["op_records"].first()["undoable"] is True and tables["scan_history"].first()["filters"] == "{}" and tables["hist_files"].count() == 0
    assert [r["root"] for r in ledger.local_roots(tables["scan_history"]).collect()] == ["/home"]
    local = read_ledger(spark, made(tmp_path / "b.db", {}))
    merged, counts = ledger.merged_import(local, tables, ledger.local_roots(tables["scan_history"]), ledger.known_paths(local["hist_files"], local["op_items"]))
    assert (counts.first()["scans_added"], counts.first()["ops_added"], counts.first()["ops_downgraded"]) == (1, 1, 0) and merged["op_items"].count() == 39


def test_what_is_no_ledger(spark, tmp_path):
    with pytest.raises(ValueError, match="op_items.state"):
        read_ledger(spark, made(tmp_path / "c.db", {}, ["op_items.state"]))
    (tmp_path / "d.db").write_bytes(b"something else" * 100)
    for name in ("d.db", "none.db"):
        with pytest.raises(ValueError, match="no ledger"):
            read_ledger(spark, str(tmp_path / name))
    assert not (tmp_path / "none.db").exists()
