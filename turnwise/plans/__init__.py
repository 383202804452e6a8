"""Named queries: importing :mod:`turnwise.plans.catalog` registers them all."""
