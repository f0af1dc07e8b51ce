"""Part of evidora; see the README for what lives here."""
