"""What holds for every query's text."""

import re

import pytest

from streamweave import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracles_hold_no_control_characters(name):
    """A pattern written without a raw string would hold a backspace where a word's border was meant."""
    assert not re.search(r"[\x00-\x08\x0b-\x1f]", catalog.ORACLE_SQL[name])


def test_exclusions_are_in_the_data():
    """Without its exclusion the ranking would be another one, on every scale."""
    from oracle import connect

    sql = catalog.ORACLE_SQL["top_named_rivers"]
    for scale in ("sf0.001", "sf0.01"):
        con = connect(f"/root/testdata/{scale}")
        kept = con.execute(sql).fetchall()
        every = con.execute(sql.replace("NOT regexp_matches", "true OR regexp_matches")).fetchall()
        assert 0 < len(kept) and kept != every
