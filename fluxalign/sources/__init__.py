"""Readers and writers of the experiment's tables, and run bookkeeping."""
