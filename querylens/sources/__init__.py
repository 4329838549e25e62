"""Readers, validators and writers of logs, judgments and runs."""
