"""Part of panelforge."""
