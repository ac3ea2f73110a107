"""Registered queries: name -> (plan, SQL used to verify it)."""
