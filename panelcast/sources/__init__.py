"""Readers, writers and the table views the registered queries run on."""
