"""scholia.sources"""
