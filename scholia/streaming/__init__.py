"""scholia.streaming"""
