"""Planners: each declares the tables of a plan (operations, decisions, reasons); none touches a file."""
