"""Tests of the language-model operators share the session of the folder above."""
