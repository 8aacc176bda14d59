"""Operators on texts and typed names; nothing outside this subpackage imports it."""
