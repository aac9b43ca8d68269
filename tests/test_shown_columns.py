"""What the asymptotic audit's query and its twin show."""
from tabaudit.catalog.slicing import cat


def test_asymptotic_audit_shows_its_floor_again():
    assert "round(tau, 6) as tau" in cat.sql["q_numeric_audit_asymptotic"]
    assert "round(tau, 6) as tau" not in cat.sql["q_numeric_audit_add"]
