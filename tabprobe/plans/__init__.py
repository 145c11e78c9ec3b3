"""Multi-step jobs: question templates, matching them to profiles, building instances."""
