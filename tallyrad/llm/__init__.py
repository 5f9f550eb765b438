"""Corpus preparation for language-model training: ten operators on whole documents."""
