"""Licence texts as they are distributed, and licences beside generic notices."""

from pathlib import Path

import pytest

from tessella.llm.license_scan import NOTICES, license_scan

COMMON = Path("/usr/share/common-licenses")
NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GFDL": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "GPL": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "LGPL": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def scan(spark, texts):
    plain = [(2000 + k, f"/p/{k}", "the river and the house of the year in it is to be this or that by any other way with all that you may have") for k in range(60)]
    rows = plain + [(k, f"/f{k}/LICENSE", t) for k, t in enumerate(texts)] + [(1000 + k, f"/f{k}/below/x.c", "int x;") for k in range(len(texts))]
    found = {r["id"]: r for r in license_scan(spark.createDataFrame(rows, "id bigint, path string, text string"), "id", "path", "text").collect()}
    assert all(found[1000 + k]["license"] == found[k]["license"] for k in range(len(texts)))
    return [found[k]["license"] for k in range(len(texts))]


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_distributed_texts(spark):
    there = [n for n in NAMES if (COMMON / n).is_file()]
    assert dict(zip(there, scan(spark, [(COMMON / n).read_text() for n in there]), strict=True)) == {n: NAMES[n] for n in there}


def test_generic_notices_never_beat_a_licence(spark):
    line = "Copyright (c) 2020 A. N. Other. All rights reserved.\nAll rights reserved.\n\n"
    names = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense", "MPL-2.0"]
    texts = [line + NOTICES[n][-1] for n in names] + [line, "Portions released under the MIT License.\n" * 3 + line]
    assert scan(spark, texts) == [*names, "Proprietary", "MIT"]


def test_versions_and_families_without_a_template_have_no_licence(spark):
    gpl = NOTICES["GPL-3.0"][1]
    texts = [gpl.replace("version 3", "version 4"), gpl.replace("GNU General", "GNU Example Library General"), NOTICES["AGPL-3.0"][0], NOTICES["LGPL-2.1"][0], NOTICES["LGPL-2.1"][0].replace("2.1", "2")]
    assert scan(spark, texts) == [None, None, "AGPL-3.0", "LGPL-2.1", None]
