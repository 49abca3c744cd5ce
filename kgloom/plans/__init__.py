"""Plans that put operators together: prompts, sizing, providers, the answer pipeline."""
